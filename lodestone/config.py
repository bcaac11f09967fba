"""Settings and rule tables. Rules are data: every operator takes them as arguments and uses these by default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Tunables that are part of the semantics; ``from_env`` reads them from environment variables of the same names."""

    faq_hit_threshold: float = 4.0
    rag_top_k: int = 7
    corpus_top_k: int = 5
    faq_top_k: int = 3
    chunk_size: int = 400
    chunk_overlap: int = 50
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    max_question: int = 200
    max_answer: int = 1000
    faq_in_context: int = 2
    fallback_chars: int = 500
    logged_chars: int = 120
    min_count: int = 2
    similarity: float = 0.5
    roster_header_rows: int = 12
    llm_timeout: int = 20
    llm_tries: int = 3
    forward_prefixes: tuple[str, ...] = field(default=("【转发学生提问】", "【转发同学提问】", "【转发学生消息】", "[转发学生提问]"))
    record_prefix: str = "【记录】"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """Names in upper case; FORWARD_PREFIX, comma-separated, replaces the default prefixes."""
        env = dict(os.environ) if env is None else env
        own = {f.name: type(getattr(cls(), f.name))(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env and f.name != "forward_prefixes"}
        if env.get("FORWARD_PREFIX"):
            own["forward_prefixes"] = tuple(p.strip() for p in env["FORWARD_PREFIX"].split(",") if p.strip())
        return replace(cls(), **own)


def read_env(text: str) -> dict[str, str]:
    """Names and values of an .env file: blank lines and comments go, as do quotes around a value."""
    pairs = (line.strip().removeprefix("export ").split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, value in pairs}


def environment(env_file: str | None = ".env", env: dict[str, str] | None = None) -> dict[str, str]:
    """What an optional .env file says, under what the environment says."""
    env = dict(os.environ) if env is None else env
    if env_file and os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as f:
            return read_env(f.read()) | env
    return env


# What sentences end with, after which long paragraphs are split.
SENTENCE_ENDS = "。!?;"

# Files that are indexed, and first letters of names that are not.
INDEXED_TYPES = (".pdf", ".docx", ".doc", ".xlsx", ".xlsm", ".txt", ".md")
PARSED_TYPES = (*INDEXED_TYPES, ".pptx")
SKIPPED_NAMES = ("~$", "00_", "_")

# Words that mark a late submission or a question.
SUBMISSION_WORDS = ("漏交", "补交", "没交", "忘了交", "忘交", "漏了交", "漏提交", "没提交", "忘提交", "作业漏", "作业没", "作业忘")
QUESTION_WORDS = ("?", "怎么", "为什么", "在哪", "哪里", "可以吗", "可不可以", "能不能", "能否", "是不是", "请问", "求助", "帮忙")

# What tells problems, course business (strong and weak) and concepts apart.
PROBLEM_REFERENCE = r"\d{1,2}\s*[.．]\s*\d{1,3}|第\s*\d{1,3}\s*题|题\s*\d{1,2}\s*[.．]\s*\d{1,3}"
HARD_BUSINESS = ("提交", "补交", "截止", "deadline", "逾期", "迟交", "没交", "漏交", "未交", "成绩", "得分", "评分", "平时分", "记分", "挂科", "及格", "考试", "小测", "期中考", "期末考", "考勤", "签到", "请假", "缺勤", "雨课堂", "学委", "课代表", "调课", "补课", "点名", "名单")
CONCEPT_MARKS = ("什么是", "是什么意思", "是啥", "的定义", "定义", "概念", "原理", "定理", "定律", "推论", "物理意义", "作用", "意义", "应用", "为什么", "为何", "怎么理解", "如何理解", "怎么推导", "推导", "证明", "怎么判断", "怎么区分", "讲解一下", "解释一下", "举例")
SOFT_BUSINESS = ("交作业", "要交", "得交", "怎么交", "交给谁", "交到哪", "交去哪", "什么时候交", "哪天交", "几号交", "几点交", "报告模板", "格式要求", "字数要求", "作业要求", "布置", "下载", "周一", "周二", "周三", "周四", "周五", "周六", "周日", "周天", "星期", "几号", "几点", "第几周")
SOFT_PATTERNS = (r"作业[^,，。！!？?\n]{0,10}(?:吗|嘛|呢|几|哪|怎么|什么|要不|能不|可以|时间|截止|交|写|格式|要求)", r"要[^,，。！!？?\n]{0,4}吗")

# Homework numbers, in order of precedence, and Chinese numerals.
HOMEWORK_PATTERNS = (r"第\s*([一二三四五六七八九十\d]+)\s*[次章]", r"作业\s*([一二三四五六七八九十\d]+)", r"实验\s*([一二三四五六七八九十\d]+)", r"(?i)chapter\s*(\d+)", r"(?i)hw\s*(\d+)")
NUMERALS = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "十": "10"}
DIGIT_NUMERALS = {**NUMERALS, "两": "2", "半": "0.5"}

# How a name is given, words that look like names, characters that no name has.
NAME_PATTERNS = (r"姓名[:：]\s*([\x{4e00}-\x{9fa5}]{2,4})", r"我[是叫]\s*([\x{4e00}-\x{9fa5}]{2,4})")
NOT_NAMES = ("老师", "助教", "学长", "学姐", "同学", "学生", "数电", "数字", "电路", "实验", "作业", "补交", "漏交", "没交", "昨天", "今天", "前天", "雨课堂", "X 老师", "我作", "我作漏", "作业漏", "作业没", "作业忘", "漏提交", "没提交", "忘提交", "老师您好", "您好", "学长好", "助教好")
NOT_IN_NAMES = "作没漏交"

# Words that say nothing about a question.
STOP_WORDS = tuple(
    """
    的 了 是 在 我 你 他 她 它 我们 你们 他们 咱们 有 和 与 或 及 就 都 也 还 很 太 不 没 没有 别
    要 会 能 可以 能否 是否 应该 需要 吗 呢 吧 啊 呀 哦 嗯 请 请问
    一下 一个 一些 一点 这个 那个 这些 那些 哪个 哪些 这里 那里 哪里 哪儿
    什么 怎么 怎样 如何 为什么 时候 什么时候 的话 以及 并且 但是 因为 所以 如果 就是 还有
    关于 对于 通过 进行 比如 例如
    这 那 这题 那题 这道 那道 这条 那条 这种 那种
    """.split()
)

# Labels of questions and answers, in the FAQ file and in records.
FAQ_QUESTION, FAQ_ANSWER = r"(?i)^\s*Q\s*[:：]\s*", r"(?i)^\s*A\s*[:：]\s*"
RECORD_QUESTION, RECORD_ANSWER = r"(?i)^\s*(?:问题|问|Q)\s*[:：]", r"(?i)^\s*(?:标准答案|答案|答|A)\s*[:：]"

# Keys and dates of facts.
FACT_KEY = r"^\s*(生效|失效|事实|来源)\s*[:：]\s*(.*)$"
FACT_DATE = r"^\s*(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?\s*$"

# Marks in corpus texts.
PAGE_MARK = r"\[教材 P(\d+)"
PAGE_MARK_WRITTEN = "[教材 P"
ANCHOR_LINE = r"(?m)^检索[:：].*$"
ANCHOR_REACH = 400

# Punctuation that does not tell questions apart.
PUNCTUATION = r"""[\s,，。.、!！?？;；:：'"“”‘’()（）\[\]【】{}<>《》~～\-—_*#/\\|]+"""

# Personal data, and what stands for it.
LONG_NUMBER = r"\d{8,}"
STUDENT_MASK, NUMBER_MASK = "[学生]", "[学号]"

# Headers of rosters and of the submission table.
ROSTER_ID_HEADERS = ("学号", "学生学号", "学号/工号", "工号")
ROSTER_NAME_HEADERS = ("姓名", "学生姓名")
SUBMISSION_HEADERS = ("登记时间", "学号", "姓名", "作业次数", "原始消息", "校验状态")

# Repair of the ohm sign, pages of scanner data, running headers, headings of problems.
OHM_MISREAD = r"(\d(?:[kKmMμnGgTt])?)Q(?![0-9A-Za-z值点参因品])"
SCANNER_PAGE = r"SS\s*号\s*=|Gener\s*al\s*I\s*nf|页数\s*=\s*\d+"
RUNNING_HEADER = r"第\s*\d{0,2}\s*(?:章|部分)|第[一二三]部分"
PROBLEM_LINE = r"(?m)^\s*(\d{1,2})\s*[.．\-]\s*(\d{1,3})(?![0-9])"
CHAPTER_IN_NAME = r"第\s*(\d{1,2})(?:\s*[-–—~]\s*(\d{1,2}))?\s*章"

# Ends of file names and editions that are no part of a title, and what stands for a missing one.
TITLE_ENDINGS = ("R",)
TITLE_EDITION = r"[（(]中文版[)）]"
UNTITLED = "讲义"

# What roster names end with, and the name of the table beside them.
ROSTER_TAILS = ("学生名单", "成绩记分册", "学生名册", "记分册", "名单")
SUBMISSION_TABLE = "补交表.xlsx"

# Signs as wide as high, and narrow ones.
WIDE_SIGNS = r"\x{2e80}-\x{10ffff}\x{2018}\x{2019}\x{201c}\x{201d}\x{2014}\x{2026}\x{00b7}"
NARROW_SIGNS = r"iIlj|!.,:;'`()\[\]{}/\\"

# Blocks that are no paragraphs; printed page headers; section headings; headings in answer files.
NOT_A_PARAGRAPH = r"^(?:[#>|<`!]|:::|[-*+]\s|\d+[.)]\s)"
PAGE_HEADER = r"^\s*(?:第\s*\d{1,2}\s*章|\d{1,2}\s*第[一二三]部分).*?(\d{1,4})\s*$"
SECTION_LINE = r"^\s*(\d{1,2})\s*[.．]\s*(\d{1,2})\s*([^\d\s].{0,20}?)\s*$"
ANSWER_HEADING = r"^\s*(?:(\d{1,2})\s*[.、]|书\s*(\d{1,2}\.\d{1,3}))"
PREAMBLE, WHOLE_TEXT = "前言", "全文"

# Words of search anchors, in order; {} stands for a chapter, a problem or a title.
ANCHOR_PROBLEM = ("电路基础", "作业", "答案", "习题", "解答", "参考")
ANCHOR_SLIDES = ("电路基础", "讲义", "课件", "课堂PPT", "概念", "定义", "原理", "定理", "定律", "方法", "讲解", "作业", "习题")
ANCHOR_BOOK = ("教材", "课本", "中文版", "第六版", "第6版")
ANCHOR_APPENDIX = "教材 附录 答案 习题答案 奇数编号 习题 自测 对答案 核对 最终结果 参考答案"
ANCHOR_PREFACE = "教材 译者序 符号 约定 国标 导线 交叉 连接 黑点 电容 电感 电压源 电流源 受控源 运算放大器 变压器 画法 不一样 怎么读图"

# Pictures, and sizes of files beyond which someone has to look first.
PICTURES = (".jpg", ".png", ".jpeg", ".webp")
LARGE_PDF = 5_000_000

# Wording of heads of texts where a course brings none of its own.
ANCHOR_LANGUAGE = "中文版"
ANCHOR_EDITION = "中文版第6版"
ANCHOR_ANSWERS_ONLY = "⚠️ 这里只有**最终答案**,没有解题过程。本项目作业题的权威解答见各章题目文件(中文版作业用书)。"
