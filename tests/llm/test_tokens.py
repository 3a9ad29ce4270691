import os
import random

import pytest

from corpusloom.llm import mixing, tokens

TOKENIZERS = pytest.importorskip("tokenizers")
JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def reference():
    t = TOKENIZERS.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


CASES = ["", " ", "a", "don't we'll THEY'RE", "a\n\n \t b  ", "漢字とかな", "ﬁ ㎏ Ⅳ 🧭", "<|endoftext|> x", "x" * 5000, "ab" * 3000, "\u0000\u0085", "É́"]


@pytest.mark.parametrize("text", CASES)
def test_cases(encoder, reference, text):
    assert encoder(text) == reference(text)


def test_random_texts(encoder, reference):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc thé 12 .,!\n漢🧭's") for _ in range(rng.randrange(80)))
        assert encoder(text) == reference(text)


def test_whole_table(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    assert got == {r.doc_id: reference(r.text or "") for r in docs.select("doc_id", "text").collect()}


def test_null_empty_repeated_and_extra_columns(spark, rows):
    docs = spark.createDataFrame([(1, None, "i"), (2, "", "i"), (3, "a", "i"), (3, "a", "i"), (None, "b", "i")], "doc_id long, text string, ids string")
    assert rows(tokens.encode(docs)) == sorted([(1, []), (2, []), (3, [64]), (3, [64]), (None, [65])], key=repr)
    assert tokens.encode(docs.limit(0)).count() == 0


def test_other_vocabulary(spark, rows):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no such vocabulary")
    docs = spark.createDataFrame([(1, "grüße aus köln")], "doc_id long, text string")
    raw = {v: k for k, v in tokens.Encoder(tokens.read_vocabulary(path)).ranks.items()}
    ids = rows(tokens.encode(docs, vocabulary=path))[0][1]
    assert b"".join(raw[i] for i in ids).decode() == "grüße aus köln"


@pytest.fixture
def mix(spark):
    counts = [(i, "big", 10) for i in range(100)] + [(1000 + i, "small", 10) for i in range(10)] + [(5000, "none", 10), (5001, None, 10)]
    counts = spark.createDataFrame(counts, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.5, 3), ("absent", 0.2, 4), ("big", 0.3, 2)], "source string, target_share double, max_repeats int")
    return counts, targets


def test_rates_and_unreachable(mix, rows):
    counts, targets = mix
    rates = {r.source: r for r in mixing.source_rates(counts, targets).collect()}
    assert rates["big"].total == 1100 and rates["big"].rate == pytest.approx(0.33) and rates["small"].rate == 3.0
    assert rows(mixing.unreachable(counts, targets)) == [("absent",), ("small",)]


def test_mixture_repeats_at_most_and_is_stable(mix, rows):
    counts, targets = mix
    rates = mixing.source_rates(counts, targets)
    first = rows(mixing.mix(counts, rates, seed=4))
    assert first == rows(mixing.mix(counts.repartition(3), rates, seed=4))
    assert sum(r[1] == "small" for r in first) == 30 and 20 <= sum(r[1] == "big" for r in first) <= 47
    shares = {r.source: r.share for r in mixing.reached_shares(counts, rates, seed=4).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["absent"] == 0.0


def test_mixing_nothing(mix, rows):
    counts, targets = mix
    assert rows(mixing.unreachable(counts.limit(0), targets)) == []
    assert rows(mixing.unreachable(counts, targets.limit(0))) == []
