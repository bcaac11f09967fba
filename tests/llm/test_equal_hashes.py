"""Texts that agree in polynomials modulo a power of two are different texts to every operator."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import idcodec, outliers, packing, prefix_counts, recompression, signature_tree, statistics, words
from lodestone.llm import queries as Q  # noqa: F401


def thue_morse(n, a, b):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


PAIRS = [(thue_morse(n, "q", "e"), thue_morse(n, "e", "q")) for n in (1024, 2048, 4096)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_and_spans_differ():
    for one, other in PAIRS:
        data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
        w = words.Words(np.array([0, len(data)]), data)
        assert w.hashes_of(0)[0] != w.hashes_of(0)[1] and w.hashes_of(1)[0] != w.hashes_of(1)[1]
        signs = words.mix(np.frombuffer(data[: len(one)].tobytes() + other.encode(), np.uint8).astype(np.uint64))
        for lane in (0, 1):
            a, b = words.span_hashes(signs, np.array([0, len(one)]), np.array([len(one), len(signs)]), lane)
            assert a != b


def test_spans_are_polynomials_modulo_the_prime():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    low = words._below(values)
    assert (words._times(low, low[::-1].copy()) == np.array([int(x) * int(y) % words.P61 for x, y in zip(low, low[::-1], strict=True)], np.uint64)).all()
    spans, base = words.Spans(values, 1), words._BASES[1]
    own = words._times(words._below(spans.total[[90]] + np.uint64(words.P61) - spans.total[[7]]), spans.down[[7]])
    assert int(own[0]) == sum(int(v) * pow(base, k, words.P61) for k, v in enumerate(values[7:90])) % words.P61


@pytest.mark.parametrize("lane", [0, 1])
def test_equal_bytes_have_equal_hashes_and_others_not(lane):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    starts = rng.integers(0, 2000, 4000)
    ends = starts + rng.integers(0, 900, 4000)
    seen = {}
    for s, e, h in zip(starts, ends, words.byte_hashes(data, starts, ends, lane), strict=True):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_statistics():
    texts = [f"{one}\n{other}\n{one}" for one, other in PAIRS]
    texts += [" ".join([*"abcd", one, *"abcd", other]) for one, other in PAIRS]
    got = []
    for _, _, s in statistics.of_batch(pa.array(texts, pa.string())):
        got += list(zip(*(s[n].tolist() for n in outliers.BASE), strict=True))
    assert got == [brute.base_statistics(t) for t in texts]


def test_token_counts_packs_and_id_files(spark, tokenizer, tokenizer_path):
    texts = [x for pair in PAIRS for x in pair]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    df = frame(spark, texts).coalesce(1)
    assert [r["n_tokens"] for r in prefix_counts.count_tokens(df, tokenizer_path).orderBy("doc_id").collect()] == [len(x) for x in ids]
    assert sorted((r["doc_id"], r["ids"]) for r in idcodec.read_ids(spark, idcodec.write_ids(df, tokenizer_path)).collect()) == [(k, [*x, 2]) for k, x in enumerate(ids)]
    for r in packing.pack(df, tokenizer_path).collect():
        assert r["ids_crc32"] == brute.crc([*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]])


def test_repeats_and_links(spark):
    start = " ".join(f"w{k}" for k in range(59))
    rows = [f"{start} {x}" for pair in PAIRS for x in pair] + [x for pair in PAIRS for x in pair]
    # The same at the level of words: long documents of two words in these orders.
    rows += [" ".join(x) for pair in PAIRS for x in pair]
    df = frame(spark, rows)
    got = {r["doc_id"]: r["n_removed"] for r in recompression.remove_repeats(df).collect()}
    assert got == {i: gone for i, _, gone, _ in brute.without_repeats(list(enumerate(rows)))}
    links = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_tree.link_documents(df).collect()}
    assert links == {i: (n, c) for i, n, c in brute.linked(list(enumerate(rows)))}
