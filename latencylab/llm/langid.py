"""Language identification by interpolated Kneser-Ney character models.

A model predicts each letter of a word, and its end, from the four symbols before it, padded at the word's
start; white space, digits and punctuation are skipped.  Per order it holds one sorted array of 64-bit n-gram
hashes with interpolated log-probabilities and one of context hashes with log back-off weights.  A text gets the
language of lowest cross-entropy per symbol.

Training: of the labelled rows, about ``TRAIN_DOCS`` of each language by a hash of id and text, and not more than about
``TRAIN_CHARS`` characters, whole texts; about every fourth of them calibrates instead:  the
sharpness that turns gaps of cross-entropy into a score, and per language the bound above which a text is
rejected.  Both limits are parameters; they also bound the models, which are broadcast.

Prediction reads every whole text once, without a shuffle.  Words repeat, so a worker keeps the scores of the
space-delimited chunks it has seen, up to ``CHUNKS``, and scores new ones in bulk.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, held, map_arrow, only, per_batch, ship_package, stored

ORDER = 5
TRAIN_DOCS = 1_000  # labelled rows per language
TRAIN_CHARS = 3_000_000  # characters per language
MODEL_BYTES = 256 << 20  # of all languages together
REJECT_MARGIN = 1.5  # times the widest deviation seen in calibration
UNSEEN_SHARE = 0.9  # of the entropy of unknown symbols; a text that reaches it is as good as unknown
SETTLED = 400  # symbols beyond which a text's entropy is not expected to come closer to the mean
CHUNKS = 200_000
LONGEST_KEPT = 200  # characters of a chunk whose scores are kept; longer ones are scored each time
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
START, END = "\x02", "\x03"
MULTIPLIER = 0x9E3779B97F4A7C15


def symbols(words: list[str]) -> np.ndarray:
    """Code points of padded words, one after another."""
    pad = START * (ORDER - 1)
    return np.frombuffer("".join([f"{pad}{w}{END}" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-grams to ``ORDER``-grams that end at each symbol; entry n - 1 has order n."""
    out, total, factor = [], np.zeros(len(codes), np.uint64), 1
    for n in range(ORDER):
        shifted = np.concatenate((np.zeros(n, np.uint64), codes[: len(codes) - n]))
        total = total + (shifted + np.uint64(1)) * np.uint64(factor)
        factor = factor * MULTIPLIER % 2**64
        mixed = total ^ (total >> np.uint64(29))
        out.append(mixed * np.uint64(0xBF58476D1CE4E5B9))
    return out


def train(words: list[str], counts: np.ndarray) -> dict[str, np.ndarray]:
    """Kneser-Ney arrays of one language from words and their counts: ``key n, value n, context n, backoff n``."""
    codes = symbols(words)
    of_word = np.cumsum(codes == ord(END)) - (codes == ord(END))
    at = np.flatnonzero(codes != ord(START))
    hashes = grams(codes)
    key = {n: hashes[n - 1][at] for n in range(1, ORDER + 1)}
    context = {n: hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64) for n in range(1, ORDER + 1)}
    # levels: n-gram keys, a place where each occurs, and counts; below the top, numbers of distinct left neighbours
    levels = {}
    keys, first, inverse = np.unique(key[ORDER], return_index=True, return_inverse=True)
    levels[ORDER] = keys, first, np.bincount(inverse, weights=counts[of_word[at]].astype(float))
    for n in range(ORDER - 1, 0, -1):
        above = levels[n + 1][1]
        keys, first, inverse = np.unique(key[n][above], return_index=True, return_inverse=True)
        levels[n] = keys, above[first], np.bincount(inverse).astype(float)
    model, lower = {}, None
    for n in range(1, ORDER + 1):
        keys, place, count = levels[n]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        contexts, group = np.unique(context[n][place], return_inverse=True)
        total, kinds = np.bincount(group, weights=count), np.bincount(group)
        gamma = discount * kinds / total
        if n == 1:
            below = np.full(len(keys), 1.0 / (len(keys) + 1))
            model["floor"] = np.array([np.log(1.0 / (len(keys) + 1))])
        else:
            below = lower[1][np.searchsorted(lower[0], key[n - 1][place])]
        p = (count - discount) / total[group] + gamma[group] * below
        lower = keys, p
        model |= {f"key{n}": keys, f"value{n}": np.log(p), f"context{n}": contexts, f"backoff{n}": np.log(gamma)}
    return model


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return place, sorted_keys[place] == wanted


def log_probabilities(model: dict[str, np.ndarray], keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Log-probability of each symbol; ``keys[n - 1]`` and ``contexts[n - 1]`` are its hashes at order n."""
    result, left = np.zeros(len(keys[0])), np.arange(len(keys[0]))
    for n in range(ORDER, 0, -1):
        place, hit = _find(model[f"key{n}"], keys[n - 1][left])
        result[left[hit]] += model[f"value{n}"][place[hit]]
        left = left[~hit]
        if not len(left):
            return result
        place, known = _find(model[f"context{n}"], contexts[n - 1][left])
        result[left[known]] += model[f"backoff{n}"][place[known]]
    result[left] += model["floor"][0]
    return result


def score_words(models: list[dict], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities for each word and model, and the number of symbols of each word."""
    codes = symbols(words)
    at = np.flatnonzero(codes != ord(START))
    hashes = grams(codes)
    of_word = (np.cumsum(codes == ord(END)) - (codes == ord(END)))[at]
    _, first, inverse = np.unique(hashes[ORDER - 1][at], return_index=True, return_inverse=True)
    place = at[first]
    keys = [h[place] for h in hashes]
    contexts = [np.zeros(len(place), np.uint64), *[h[place - 1] for h in hashes[:-1]]]
    sums = [np.bincount(of_word, weights=log_probabilities(m, keys, contexts)[inverse], minlength=len(words)) for m in models]
    return np.stack(sums, axis=1), np.bincount(of_word, minlength=len(words))


class Scorer(dict):
    """Scores of whole texts: chunk to row number; rows hold a chunk's log-probabilities and symbols."""

    def __init__(self, models: list[dict]):
        super().__init__()
        self.models, self.pending = models, []
        self.sums, self.sizes = np.zeros((1024, len(models))), np.zeros(1024, np.int64)

    def __missing__(self, chunk):
        self[chunk] = n = len(self)
        self.pending.append(chunk)
        return n

    def _score_pending(self):
        start, chunks = len(self) - len(self.pending), self.pending
        self.pending = []
        while len(self.sizes) < len(self):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        words, owner = [], []
        for k, chunk in enumerate(chunks):
            for w in LETTERS.findall(chunk.lower()):
                words.append(w)
                owner.append(start + k)
        self.sums[start:len(self)], self.sizes[start:len(self)] = 0, 0
        if words:
            sums, sizes = score_words(self.models, words)
            np.add.at(self.sums, owner, sums)
            np.add.at(self.sizes, owner, sizes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log-probability under each model, and the number of symbols scored."""
        if len(self) > CHUNKS:
            self.clear()
        rows, long = [], []
        for row, text in enumerate(texts):
            chunks = text.split()
            if len(text) > LONGEST_KEPT and max(map(len, chunks), default=0) > LONGEST_KEPT:
                long += [(row, w) for c in chunks if len(c) > LONGEST_KEPT for w in LETTERS.findall(c.lower())]
                chunks = [c for c in chunks if len(c) <= LONGEST_KEPT]
            rows.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        if self.pending:
            self._score_pending()
        sums = np.stack([self.sums[r].sum(0) for r in rows]) if rows else np.zeros((0, len(self.models)))
        sizes = np.array([self.sizes[r].sum() for r in rows], np.int64)
        if long:
            more, symbols_of = score_words(self.models, [w for _, w in long])
            at = [row for row, _ in long]
            np.add.at(sums, at, more)
            np.add.at(sizes, at, symbols_of)
        return sums, sizes


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {k: arrays[k] for k in arrays.files}


def sample(labelled: DataFrame, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """``id, text, lang, calibrates`` of the rows to learn from: those whose hash is below a share of its range.

    The share of a language follows from its counts, so that about ``docs`` rows and ``chars`` characters are expected
    at most; nothing is ranked.  A row is told by id, language and a checksum of its text: an id with many texts is not
    taken as a whole, and rows listed again count once.
    """
    key = ["id", "lang", "tag"]
    light = labelled.select("id", "lang", F.xxhash64("text").alias("tag"), F.length("text").alias("size")).where("size > 0")
    light = light.groupBy(*key).agg(F.first("size").alias("size"))
    totals = light.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    share = totals.select("lang", F.least(F.lit(1.0), docs / F.col("n"), chars / F.col("total")).alias("share"))
    drawn = light.withColumn("hash", F.xxhash64("id", "tag")).join(share, "lang")
    chosen = drawn.where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    calibrates = F.pmod(F.shiftright("hash", 32), F.lit(4)) == 0
    chosen = stored(chosen.select(*key, calibrates.alias("calibrates")), "language-sample")
    if chosen.count() <= 200_000:
        chosen = F.broadcast(chosen)
    rows = labelled.where(F.length("text") > 0).withColumn("tag", F.xxhash64("text")).join(chosen, key)
    rows = rows.groupBy(*key).agg(F.first("text").alias("text"), F.first("calibrates").alias("calibrates"))
    return stored(rows.select("id", "text", "lang", "calibrates"), "language-texts")


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` over some texts; words are combined per slice and again before the shuffle."""

    def work(rows):
        found: dict[tuple, int] = {}
        for text, lang in zip(rows["text"], rows["lang"]):
            for word in LETTERS.findall(text.lower()):
                found[lang, word] = found.get((lang, word), 0) + 1
        return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    return per_batch(texts.select("text", "lang"), "lang string, word string, n bigint", work).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _train_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("word")
    model = pack(train(rows["word"].tolist(), rows["n"].to_numpy()))
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "model": [model]})


class Identifier:
    """Models of all languages with their calibration; predicts from texts alone."""

    def __init__(self, languages: list[str], packed: list[bytes], sharpness: float = 1.0, bounds: list[tuple[float, float, float]] | None = None):
        self.languages, self.packed, self.sharpness, self.bounds = languages, packed, sharpness, bounds
        self.key = hashlib.sha256(b"".join(packed)).hexdigest()

    def scorer(self) -> Scorer:
        return held(("languages", self.key), lambda: Scorer([unpack(m) for m in self.packed]))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol under each model (infinite without a letter), and the number of symbols."""
        sums, sizes = self.scorer()([t or "" for t in texts])
        return np.where(sizes[:, None] > 0, -sums / np.maximum(sizes, 1)[:, None], np.inf), sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score (0 to 1), cross-entropy, and whether the text is accepted."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)
        entropy, sizes = self.entropies(texts)
        languages, scores, least, accepted = [], [], [], []
        for row, n in zip(entropy, sizes.tolist()):
            if not n:
                languages.append(UNKNOWN)
                scores.append(0.0)
                least.append(None)
                accepted.append(False)
                continue
            best = int(np.argmin(row))  # the first of equals, in the order of names
            h = float(row[best])
            mean, width, foreign = self.bounds[best] if self.bounds else (h, 0.0, h)
            gaps = np.exp(-self.sharpness * np.sqrt(n) * (row - h))
            languages.append(self.languages[best])
            scores.append(float(1.0 / gaps.sum()))
            least.append(h)
            accepted.append(bool(h <= max(mean + width / np.sqrt(min(n, SETTLED)), foreign)))
        return languages, scores, least, accepted


def calibrate(identifier: Identifier, texts: DataFrame) -> Identifier:
    """Fit sharpness and rejection bounds on texts of known language that the models have not seen.

    A text is rejected if its least entropy is both further above the language's mean than any calibration text
    was above its own (with a margin, and scaled by length) and as high as that of texts in other languages.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(identifier)

    def work(rows):
        entropy, sizes = shipped.value.entropies(rows["text"])
        return {"lang": rows["lang"], "n": sizes, "h": entropy.tolist()}

    rows = per_batch(texts, "lang string, n bigint, h array<double>", work).where("n > 0").collect()  # of a bounded sample
    bounds = [(0.0, np.inf, np.inf)] * len(identifier.languages)
    if not rows:
        return Identifier(identifier.languages, identifier.packed, 1.0, bounds)
    entropy, sizes = np.array([r["h"] for r in rows]), np.array([r["n"] for r in rows])
    truth = np.array([identifier.languages.index(r["lang"]) for r in rows])
    own = entropy[np.arange(len(rows)), truth]
    means = {k: float(np.average(own[truth == k], weights=sizes[truth == k])) for k in set(truth.tolist())}
    away = (own - np.array([means[k] for k in truth])) * np.sqrt(np.minimum(sizes, SETTLED))
    for k, mean in means.items():
        others = entropy[truth != k, k]
        model = unpack(identifier.packed[k])
        unseen = float(-(model["floor"][0] + model["backoff1"][0]))  # entropy of symbols the model does not know
        foreign = min(float(np.quantile(others, 0.01)), UNSEEN_SHARE * unseen) if len(others) else -np.inf
        bounds[k] = mean, REJECT_MARGIN * float(away.max()), foreign
    least = entropy.min(axis=1, keepdims=True)

    def loss(sharpness):
        z = -sharpness * np.sqrt(sizes)[:, None] * (entropy - least)
        return -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()

    sharpness = min((0.25 * 2 ** (k / 2) for k in range(13)), key=loss)
    return Identifier(identifier.languages, identifier.packed, sharpness, bounds)


def fit(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Identifier:
    """Learn from rows with a text and a language; others are left out, as are rows with a null id.

    Without such rows the identifier knows no language and answers ``und`` with score 0.
    """
    rows = only(labelled, id=id_col, text=text_col, lang=lang_col).where("id is not null and text is not null and lang is not null")
    texts = sample(rows, docs, chars)
    ship_package(labelled.sparkSession)
    learn = texts.where("not calibrates")
    models = word_counts(learn).groupBy("lang").applyInPandas(_train_group, "lang string, model binary").orderBy("lang").collect()
    if sum(len(m["model"]) for m in models) > MODEL_BYTES:
        raise ValueError(f"models of {len(models)} languages exceed {MODEL_BYTES} bytes; lower chars={chars}")
    found = Identifier([m["lang"] for m in models], [bytes(m["model"]) for m in models])
    known = texts.where("calibrates").where(F.col("lang").isin(found.languages)) if models else texts.limit(0)
    return calibrate(found, known.select("text", "lang"))


def identify(docs: DataFrame, identifier: Identifier, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, lang_pred, score, cross_entropy, accepted`` for every row.

    A null text, or one without a letter, is ``und`` with score 0 and not accepted.  Equal texts get equal
    answers; repeated rows, null ids and extra columns do not matter.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(identifier)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        languages, scores, least, accepted = shipped.value.predict(rows["text"])
        return {"id": rows["id"], "lang_pred": languages, "score": scores, "cross_entropy": least, "accepted": accepted}

    schema = f"id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean"
    return per_batch(only(docs, id=id_col, text=text_col), schema, work)


def accepted_rows(docs: DataFrame, identifier: Identifier, text_col="text") -> DataFrame:
    """The rows, all columns, whose text is accepted as one of the known languages."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(identifier)
    schema = f"row {row.schema['row'].dataType.simpleString()}"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keep = pa.array(shipped.value.predict(part.column("text").to_pylist())[3], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("row").filter(keep).cast(out.field(0).type)], schema=out)

    return map_arrow(row, run, schema).select(*[F.col("row")[c].alias(c) for c in docs.columns])
