"""Deobfuscation against enumeration of all readings; scores against direct versions and held-out labels."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latencylab.llm import toxicity as tx

WORDS = "the and of to in that is for with this was are idiot stupid moron trash worthless clown loser pathetic people between letter".split()


def counts_of(words):
    found = collections.Counter()
    for w in words:
        padded = ["^"] * 3 + [c if ord(c) < tx.LATIN else "?" for c in w] + ["$"]
        for i in range(3, len(padded)):
            found["".join(padded[i - 3:i + 1])] += 1
    return found


def direct_cost(grams: collections.Counter, context: str, symbol: str) -> float:
    """Interpolated Witten-Bell from plain dictionaries."""
    p = 1.0 / (len({g[3] for g in grams}) + 1)
    for n in range(4):
        rest = (context + symbol)[3 - n:]
        seen = [(g, c) for g, c in grams.items() if g[3 - n:3] == rest[:-1]]
        if not seen:
            break
        total, kinds = sum(c for _, c in seen), len({g[3] for g, _ in seen})
        p = (sum(c for g, c in seen if g[3 - n:] == rest) + kinds * p) / (total + kinds)
    return -math.log(p)


@pytest.fixture(scope="module")
def model():
    return tx.CharModel(*tx.gram_counts(WORDS, list(range(1, len(WORDS) + 1))))


def test_character_model_is_witten_bell():
    words = ["abab", "abc", "ba", "çé", "三b", "b"]
    counts = [3, 1, 2, 1, 2, 1]
    built = tx.CharModel(*tx.gram_counts(words, counts))
    grams = counts_of([w for w, n in zip(words, counts) for _ in range(n)])
    named = {tx.START: "^", tx.END: "$", "三": "?"}
    for context in itertools.product([tx.START, "a", "b", "c", "三"], repeat=3):
        for symbol in ["a", "b", "z", "三", tx.END]:
            plain = "".join(named.get(c, c) for c in context), named.get(symbol, symbol)
            assert built.cost("".join(context), symbol) == pytest.approx(direct_cost(grams, *plain), abs=1e-12)
    assert tx.CharModel(np.zeros(0, np.int64), np.zeros(0, np.int64)).cost(tx.OPEN, "a") == 0.0


def cheapest(model, context, typed, right, ends):
    lengths, options, best = tx.runs(typed), [], None
    for i, ch in enumerate(typed):
        if ch.isalpha():
            same = i and typed[i - 1] == ch
            options.append([("letter", ch, 0.0), *([("skip", "", tx.DOUBLED if lengths[i] == 2 else tx.STRETCHED)] if same else [])])
        else:
            stands = lengths[i] < tx.LINE
            others = [("inside", "", tx.SEPARATED), *[("letter", x, tx.SUBSTITUTED) for x in tx.READINGS.get(ch, "")]]
            options.append([("break", " ", 0.0), *(others if stands else [])])
    for path in itertools.product(*options):
        state, price, text = context, 0.0, ""
        for kind, letter, extra in path:
            if kind == "inside" and state == tx.OPEN:
                break
            if kind == "letter":
                price += model.cost(state, letter)
                state, text = (state + letter)[-3:], text + letter
            elif kind == "break" and state != tx.OPEN:
                price, state, text = price + model.cost(state, tx.END), tx.OPEN, text + " "
            price += extra
        else:
            for ch in right:
                price, state = price + model.cost(state, ch), (state + ch)[-3:]
            if ends and state != tx.OPEN:
                price += model.cost(state, tx.END)
            if best is None or price < best[0] - 1e-9:
                best = price, text
    return best[1]


def test_search_finds_the_cheapest_reading(model):
    rnd = random.Random(3)
    for _ in range(400):
        typed = "".join(rnd.choice("aabit1!.**00dd3") for _ in range(rnd.randint(1, 6)))
        context, right = rnd.choice([tx.OPEN, tx.START * 2 + "t", "the", "idi"]), rnd.choice(["", "t", "the"])
        if rnd.random() < 0.3:
            typed = rnd.choice("abit") * 2
        args = model, context, typed, right, len(right) < 3
        assert tx.decode(*args) == cheapest(*args)


def test_regions_do_not_change_the_reading(model):
    restorer, rnd = tx.Restorer(model), random.Random(4)
    for _ in range(300):
        chunk = "".join(rnd.choice("idiotstupmrn1!0$.eel") for _ in range(rnd.randint(1, 14)))
        whole = tx.decode(model, tx.OPEN, chunk.strip(tx.AROUND), "", True).split()
        assert restorer.words(chunk) == whole


@pytest.mark.parametrize("typed", ["1d10t", "id!ot", "iiidiot", "i.d.i.o.t", "*idiot*", "idi0t!!!", "(idiot),", "i-diot", "idio+"])
def test_disguised_word(model, typed):
    assert tx.Restorer(model).words(typed) == ["idiot"]


def test_plain_words_stay_and_spaces_close(model):
    restorer = tx.Restorer(model)
    assert restorer.words("between") == ["between"] and restorer.words("worthless.") == ["worthless"]
    assert restorer.words("----") == [] and restorer.words("") == [] and restorer.words("*" * 50_000) == []
    assert tx.spaced_runs("is m 0 r o n, and a b cd") == [["m", "0", "r", "o", "n"]]
    assert restorer.spaced(list("m0ron")) == ["moron"]
    assert restorer.words("9" * 20_000 + "a1" * 5_000) is not None


def test_logistic_is_a_stationary_point():
    rnd = np.random.default_rng(1)
    x = np.hstack([rnd.random((300, 4)), np.ones((300, 1))])
    y = (x[:, 0] + 0.3 * rnd.random(300) > 0.7).astype(float)
    weight = rnd.random(300) + 0.5
    w = tx.logistic(x, y, weight)
    p = 1 / (1 + np.exp(-x @ w))
    gradient = x.T @ (weight * (p - y)) + np.array([tx.RIDGE] * 4 + [1e-3]) * w
    assert np.abs(gradient).max() < 1e-6


DOCS = "doc_id bigint, text string, score string, label int, id string"


def corpus(n=600, seed=5):
    rnd, rows, labels = random.Random(seed), [], []
    clean = [w for w in WORDS if w not in ("idiot", "stupid", "moron", "trash")]
    for i in range(n):
        toxic = i % 5 == 0
        words = [rnd.choice(clean) for _ in range(30)]
        if toxic:
            for _ in range(4):
                words[rnd.randrange(30)] = rnd.choice(["idiot", "stupid", "moron", "trash"])
        rows.append((i, " ".join(words), "x", 3, "y"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores_of_disguised_texts(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scorer = tx.fit(docs, known)
    tests = [
        (1, "you are an 1d10t and a m0r0n with this tr4sh", "", 0, ""), (2, "this is s t u p i d and m-o-r-o-n of trrrash", "", 0, ""),
        (3, "the people of that letter are with this", "", 0, ""), (4, None, "", 0, ""), (5, "", "", 0, ""), (None, "IDIOT! MORON! TRASH!", "", 0, ""),
        (1, "you are an 1d10t and a m0r0n with this tr4sh", "", 0, ""), (6, "the 10 people with 4 and 5 are in 2019 this", "", 0, ""),
    ]
    got = tx.score(spark.createDataFrame(tests, DOCS), scorer).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r["id"]].append((r["score"], r["predicted"]))
    assert len(got) == len(tests) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [found[k][0][1] for k in (1, 2, None)] == [1, 1, 1] and [found[k][0][1] for k in (3, 4, 5, 6)] == [0] * 4
    assert found[1][0] == found[1][1] and found[4] == found[5]


def test_rates_scores_and_sample_bound(spark):
    rows, labels = corpus(400)
    rows += [(7, f"the people {i}", "", 0, "") for i in range(300)]  # a hot id
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels + [(7, 0)] * 200, "id bigint, label int")
    sample, share = tx.training_rows(docs.select(F.col("doc_id").alias("id"), "text"), known, 40)
    n = collections.Counter(r["label"] for r in sample.collect())
    assert 20 < n[1] < 70 and n[0] < 200 and share[1] == pytest.approx(40 / 80)
    scorer = tx.fit(docs, known.toDF("doc_id", "toxic"))
    reader = tx.Reader(scorer.reader().restorer.model, scorer.features)
    text = rows[0][1]
    words, features = reader(text)
    assert words == 30
    z = scorer.weights[-1] + sum(scorer.weights[f] * math.log1p(100 * k / 50) for f, k in features.items())
    assert scorer.score([text]) == pytest.approx([1 / (1 + math.exp(-z))])


def test_no_labels_one_class_and_no_rows(spark):
    rows, _ = corpus(50)
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in tx.score(docs, tx.fit(docs, none)).collect()} == {0}
    toxic = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in tx.score(docs, tx.fit(docs, toxic)).collect()} == {1}
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).collect() == []


def test_held_out_labels(spark, sf_dir):
    import duckdb
    from latencylab.llm import queries

    got = queries.QUERIES["op11_toxicity"](spark, sf_dir).toPandas()
    labels = duckdb.sql(f"select * from '{sf_dir}/labels.parquet'").df()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 200 and (both.predicted == both.toxic).mean() > 0.9
