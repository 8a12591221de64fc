"""Toxicity of texts that may be disguised: noisy-channel decoding, then a linear score of the restored words.

Channel: a writer means lower-case words and types them with digits or symbols for letters, with separators between
the letters, or with letters repeated.  Source: an interpolated (Witten-Bell) character 4-gram model of the words of
all documents.  What was meant is the cheapest path through the lattice of readings of what was typed, found by
Viterbi search over the model's contexts.  Where three plain letters follow each other the context is forced, so the
lattice falls into independent regions; each is decoded once for a worker, and a plain word is its own only path.

Score: logistic regression on the rates of restored words and word beginnings that tell toxic from other texts by
their likelihood ratio.  The labelled rows to learn from are a bounded sample (``TRAIN_DOCS`` a class, by a hash of
their ids); everything else covers all documents.  A prediction reads whole texts, once, without a shuffle.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, held, map_arrow, only, per_batch, ship_package, stored

TRAIN_DOCS = 4_000  # labelled rows to learn from in each class, in expectation
FEATURES = 400
BEGINNINGS = (4, 5, 6, 7, 8)  # letters of a word's beginning that is a feature
RIDGE = 0.3
MEMO = 150_000  # chunks and costs that a worker keeps, each; half as many decoded regions
LONGEST_KEPT = 64  # characters of a chunk that is kept
FLUSH = 100_000  # distinct chunks counted before their n-grams are handed on
# Letters that a digit or symbol can stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c", "€": "e",
}
# Costs of the channel, as negative logarithms.
SUBSTITUTED, SEPARATED, DOUBLED, STRETCHED = 2.5, 2.0, 6.0, 0.7
LINE = 4  # equal symbols in a row that are a line and stand for no letters
START, END, OTHER = "\x02", "\x03", 1
OPEN = START * 3
LATIN = 0x250  # letters from here on share one symbol of the model
SHIFT = 10
AROUND = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in READINGS) + "…«»“”„‘’–—"
REGION = re.compile(r"([^\W\d_])\1+|[\W\d_]+")
LETTERS = re.compile(r"[^\W\d_]+")
MARK, SIGN = f"[{re.escape(AROUND)}]?", f"[\\w{re.escape(''.join(READINGS))}]"
SPACED = re.compile(rf"(?<!\S){MARK}{SIGN}{MARK}(?:\s+{MARK}{SIGN}{MARK}(?!\S)){{2,}}")
SINGLE = re.compile(SIGN)


# --- source: character model --------------------------------------------------------------------

def gram_counts(words: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-grams of padded words and how often they occur."""
    text = np.frombuffer("".join([f"{OPEN}{w}{END}" for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) + 4 for w in words])
    symbols = np.where(text < LATIN, text, OTHER)
    codes = symbols.copy()
    for n in (1, 2, 3):
        codes[n:] += symbols[:-n] << (SHIFT * n)
    at = np.flatnonzero(text != ord(START))
    found, group = np.unique(codes[at], return_inverse=True)
    return found, np.bincount(group, weights=np.repeat(np.array(counts), sizes)[at]).astype(np.int64)


def corpus_grams(docs: DataFrame) -> DataFrame:
    """``code, n``: 4-grams of the words of all texts; a task hands on sums, not words."""
    schema = "code bigint, n bigint"
    out = arrow_schema(schema)

    def emit(chunks: Counter):
        words: Counter = Counter()
        for chunk, n in chunks.items():
            for w in LETTERS.findall(chunk):
                words[w] += n
        if words:
            codes, counts = gram_counts(list(words), list(words.values()))
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], schema=out)

    def run(batches):
        chunks: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    if text:
                        chunks.update(text.lower().split())
                    if len(chunks) > FLUSH:
                        yield from emit(chunks)
                        chunks = Counter()
        yield from emit(chunks)

    return map_arrow(docs.select("text"), run, schema).groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """Costs (negative log-probabilities) of a letter, or a word's end, after the three symbols before it."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.gram, self.total, self.kinds = [None], [None], [None]
        for n in (1, 2, 3, 4):
            keys, group = np.unique(codes & ((1 << SHIFT * n) - 1), return_inverse=True)
            sums = np.bincount(group, weights=counts) if len(keys) else np.zeros(0)
            contexts, of = np.unique(keys >> SHIFT, return_inverse=True)
            # the context of a gram is what stands before its last symbol
            self.gram.append(dict(zip(keys.tolist(), sums.tolist())))
            self.total.append(dict(zip(contexts.tolist(), np.bincount(of, weights=sums).tolist() if len(keys) else [])))
            self.kinds.append(dict(zip(contexts.tolist(), np.bincount(of).tolist() if len(keys) else [])))
        self.floor = 1.0 / (len(self.gram[1]) + 1)
        self.known: dict[str, float] = {}

    def cost(self, context: str, symbol: str) -> float:
        key = context + symbol
        found = self.known.get(key)
        if found is None:
            if len(self.known) > MEMO:
                self.known.clear()
            code = 0
            for c in key:
                code = code << SHIFT | (ord(c) if ord(c) < LATIN else OTHER)
            p = self.floor
            for n in (1, 2, 3, 4):
                gram = code & ((1 << SHIFT * n) - 1)
                total = self.total[n].get(gram >> SHIFT)
                if total is None:
                    break
                kinds = self.kinds[n][gram >> SHIFT]
                p = (self.gram[n].get(gram, 0.0) + kinds * p) / (total + kinds)
            found = self.known[key] = -math.log(p)
        return found


# --- channel: lattice and search ----------------------------------------------------------------

def runs(typed: str) -> list[int]:
    """For each character the length of its run of equal characters."""
    return [n for _, g in itertools.groupby(typed) for n in [len(list(g))] for _ in range(n)]


def decode(model: CharModel, context: str, typed: str, right: str, ends: bool) -> str:
    """The cheapest reading of a region, words separated by spaces.

    ``context`` holds the three symbols before it; ``right`` the plain letters behind it (three, or what is left
    of the chunk if it ``ends`` there).
    """
    cost = model.cost
    if len(typed) == 2 and typed[0] == typed[1] and typed[0].isalpha():  # two readings
        once = (context + typed[0])[-3:]
        twice, spare = cost(once, typed[0]), DOUBLED
        one, two = once, (once + typed[0])[-3:]
        for ch in right + END * ends:
            spare, twice = spare + cost(one, ch), twice + cost(two, ch)
            one, two = (one + ch)[-3:], (two + ch)[-3:]
        return typed[0] if spare < twice else typed
    paths = {context: (0.0, None)}
    lengths, before = runs(typed), ""
    for ch, length in zip(typed, lengths):
        following: dict[str, tuple] = {}

        def offer(state, price, out):
            if state not in following or price < following[state][0]:
                following[state] = price, out

        letter = ch.isalpha()
        for state, (price, out) in paths.items():
            if letter:
                offer((state + ch)[-3:], price + cost(state, ch), (out, ch))
                if ch == before:
                    offer(state, price + (DOUBLED if length == 2 else STRETCHED), out)
                continue
            if state == OPEN:
                offer(OPEN, price, out)
            else:
                offer(OPEN, price + cost(state, END), (out, " "))
                if length < LINE:
                    offer(state, price + SEPARATED, out)
            for meant in READINGS.get(ch, "") if length < LINE else "":
                offer((state + meant)[-3:], price + SUBSTITUTED + cost(state, meant), (out, meant))
        paths, before = following, ch
    best = None
    for state, (price, out) in paths.items():
        for ch in right:
            price += cost(state, ch)
            state = (state + ch)[-3:]
        if ends and state != OPEN:
            price += cost(state, END)
        if best is None or price < best[0]:
            best = price, out
    letters, out = [], best[1]
    while out:
        out, ch = out
        letters.append(ch)
    return "".join(reversed(letters))


class Restorer:
    """Restored words of typed chunks; decoded regions are kept."""

    def __init__(self, model: CharModel):
        self.model, self.regions = model, {}

    def region(self, context: str, typed: str, right: str, ends: bool) -> str:
        key = context, typed, right, ends
        found = self.regions.get(key)
        if found is None:
            found = decode(self.model, *key)
            if len(typed) <= LONGEST_KEPT:
                if len(self.regions) > MEMO // 2:
                    self.regions.clear()
                self.regions[key] = found
        return found

    def words(self, chunk: str) -> list[str]:
        """Words meant by a lower-case chunk without white space."""
        core = chunk.strip(AROUND)
        found = [m.span() for m in REGION.finditer(core)]
        if not found:
            return [core] if core else []
        merged = [list(found[0])]
        for a, b in found[1:]:
            if a - merged[-1][1] < 3:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        parts, at = [], 0
        for a, b in merged:
            right = core[b:b + 3]
            parts += (core[at:a], self.region((OPEN + core[max(0, a - 3):a])[-3:], core[a:b], right, len(core) <= b + 3))
            at = b
        return ("".join(parts) + core[at:]).split()

    def spaced(self, letters: list[str]) -> list[str]:
        """Words meant by single characters with white space between them."""
        return self.region(OPEN, " ".join(letters), "", True).split()


def spaced_runs(text: str) -> list[list[str]]:
    """Stretches of three or more chunks that are single letters or signs, with at most a mark on either side."""
    return [SINGLE.findall(m[0]) for m in SPACED.finditer(text)]


# --- score --------------------------------------------------------------------------------------

def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


PLAIN, NO_WORD = (1, ()), (0, ())  # a chunk that is one word without features, or none


class Reader:
    """Counts of restored words and of the features among them, for whole texts."""

    def __init__(self, model: CharModel, features: list[str]):
        self.restorer, self.memo = Restorer(model), {}
        self.index = {f: i for i, f in enumerate(features)}
        self.heads = {f.rstrip("*")[:BEGINNINGS[0]] for f in features}

    def _features(self, words: list[str]) -> tuple[int, tuple]:
        found = []
        for w in words:
            if w[:BEGINNINGS[0]] in self.heads:
                found += [i for f in word_features(w) if (i := self.index.get(f)) is not None]
        return len(words), tuple(found)

    def all_features(self, text: str | None) -> set[str]:
        """Every feature that occurs in a text."""
        text, found = (text or "").lower(), set()
        for chunk in set(text.split()):
            found.update(*map(word_features, self.restorer.words(chunk)))
        for letters in spaced_runs(text):
            found.update(*map(word_features, self.restorer.spaced(letters)))
        return found

    def _of(self, chunk: str) -> tuple[int, tuple]:
        """Words and features of a chunk that is not kept yet."""
        core = chunk.strip(AROUND)
        if core[:BEGINNINGS[0]] not in self.heads and not REGION.search(core):
            found = PLAIN if core else NO_WORD
        else:
            found = self._features(self.restorer.words(chunk))
        if len(chunk) <= LONGEST_KEPT:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[chunk] = found
        return found

    def __call__(self, text: str | None) -> tuple[int, Counter]:
        """Number of restored words, and how often each feature occurs."""
        text = (text or "").lower()
        words, found, get = 0, Counter(), self.memo.get
        for chunk, n in Counter(text.split()).items():
            known = get(chunk) or self._of(chunk)
            if known is PLAIN:
                words += n
                continue
            size, features = known
            words += n * size
            for f in features:
                found[f] += n
        # characters of spaced words have counted as words of their own already; a letter is no feature
        for letters in spaced_runs(text):
            n, features = self._features(self.restorer.spaced(letters))
            words += n
            found.update(features)
        return words, found


def rates(words: int, found: Counter) -> dict:
    """Feature values: logarithm of one plus occurrences in a hundred words, cautious about short texts."""
    return {f: math.log1p(100 * n / (words + 20)) for f, n in found.items()}


class Scorer:
    """Character model, features and weights; scores texts alone."""

    def __init__(self, grams: bytes, features: list[str], weights: np.ndarray):
        self.grams, self.features, self.weights = grams, features, weights
        self.key = hashlib.sha256(grams + repr(features).encode()).hexdigest()

    def reader(self) -> Reader:
        def make():
            with np.load(io.BytesIO(self.grams)) as arrays:
                return Reader(CharModel(arrays["codes"], arrays["counts"]), self.features)

        return held(("toxicity", self.key), make)

    def score(self, texts: list[str | None]) -> list[float]:
        reader, out = self.reader(), []
        for text in texts:
            z = float(self.weights[-1]) + sum(float(self.weights[f]) * v for f, v in rates(*reader(text)).items())
            out.append(1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0)
        return out


def logistic(values: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column is the constant and not penalised."""
    penalty = np.full(values.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(values.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(values @ w, -30, 30)))
        step = np.linalg.solve((values * (weights * p * (1 - p))[:, None]).T @ values + np.diag(penalty), values.T @ (weights * (p - labels)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Stored ``text, label`` of a bounded sample of labelled rows, and the share of each class that it holds."""
    known = labels.groupBy("id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    share = {c: min(1.0, per_class / n) for c, n in totals.items()}
    limit = lambda s: F.when(F.col("label") == 1, s.get(1, 0.0)).otherwise(s.get(0, 0.0))
    chosen = known.where(part("id") < limit(share))  # some per_class rows a class, whatever the table
    rows = docs.join(F.broadcast(chosen), "id").withColumn("tag", F.xxhash64("text"))
    rows = stored(rows.groupBy("id", "tag", "label").agg(F.first("text").alias("text")), "toxicity-texts")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # ids with many texts: a second cut by id and text
    again = {c: min(1.0, 2 * per_class / n) for c, n in found.items()}
    rows = rows.where(part("id", "tag", F.lit(1)) < limit(again)).select("text", "label")
    return rows, {c: share[c] * again.get(c, 1.0) for c in totals}


def choose_features(rows: DataFrame, scorer: Scorer, limit: int) -> list[str]:
    """Words and beginnings that more toxic than other texts have, by the likelihood ratio of their presence."""
    shipped = rows.sparkSession.sparkContext.broadcast(scorer)

    def work(part):
        reader, found = shipped.value.reader(), {0: Counter(), 1: Counter()}
        for text, label in zip(part["text"], part["label"]):
            found[label].update(reader.all_features(text))
        every = list(found[0].keys() | found[1].keys())
        return {"feature": every, "clean": [found[0][f] for f in every], "toxic": [found[1][f] for f in every]}

    counts = per_batch(rows, "feature string, clean bigint, toxic bigint", work)
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = float(n.get(1, 0)), float(n.get(0, 0))
    if not pos or not neg:
        return []
    term = "if({k} > 0, {k} * ln({k} / {n}), 0D)"
    both = lambda k, n: f"{term.format(k=f'cast({k} as double)', n=n)} + {term.format(k=f'({n} - {k})', n=n)}"
    ratio = f"2 * ({both('a', f'{pos}D')} + {both('b', f'{neg}D')} - ({both('(a + b)', f'{pos + neg}D')}))"
    scored = counts.where(f"a / {pos}D > b / {neg}D").selectExpr("feature", f"round({ratio}, 6) as ratio")
    return [r["feature"] for r in scored.orderBy(F.desc("ratio"), "feature").limit(limit).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", per_class: int = TRAIN_DOCS, features: int = FEATURES) -> Scorer:
    """Learn the character model from all texts, the score from a sample of the labelled ones.

    Labels other than 0 and 1 and null ids are left out; an id labelled both ways counts as toxic.  Without rows of
    both classes there are no features: every score is the share of toxic rows (0 without any label).
    """
    ship_package(docs.sparkSession)
    rows = only(docs, id=id_col, text=text_col)
    grams = corpus_grams(rows).orderBy("code").collect()  # bounded by the alphabet, not by the texts
    packed = io.BytesIO()
    np.savez(packed, codes=np.array([r["code"] for r in grams], np.int64), counts=np.array([r["n"] for r in grams], np.int64))
    scorer = Scorer(packed.getvalue(), [], np.zeros(1))
    known = only(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
    known = known.withColumn("label", F.col("label").cast("int"))
    texts, share = training_rows(rows, known, per_class)
    scorer = Scorer(scorer.grams, choose_features(texts, scorer, features), np.zeros(1))
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(part):
        reader = shipped.value.reader()
        made = [rates(*reader(t)) for t in part["text"]]
        return {"label": part["label"], "at": [list(m) for m in made], "value": [list(m.values()) for m in made]}

    sample = per_batch(texts, "label int, at array<int>, value array<double>", work).collect()  # of a bounded sample
    if not sample or not scorer.features:
        n = {c: sum(r["label"] == c for r in sample) / max(share.get(c, 1.0), 1e-12) for c in (0, 1)}
        rate = n[1] / sum(n.values()) if sample else 0.0
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return Scorer(scorer.grams, [], np.array([math.log(rate / (1 - rate))]))
    values = np.zeros((len(sample), len(scorer.features) + 1))
    values[:, -1] = 1.0
    for row, r in zip(values, sample):
        row[r["at"]] = r["value"]
    truth = np.array([r["label"] for r in sample], float)
    weight = np.array([1 / share[r["label"]] for r in sample])
    return Scorer(scorer.grams, scorer.features, logistic(values, truth, weight * len(weight) / weight.sum()))


def score(docs: DataFrame, scorer: Scorer, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, score, predicted`` for every row.

    Null and empty texts get the score of a text without words.  Equal texts get equal scores; repeated rows, null
    ids and extra columns do not matter.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(part):
        scores = shipped.value.score(part["text"])
        return {"id": part["id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(only(docs, id=id_col, text=text_col), f"id {kind}, score double, predicted int", work)
