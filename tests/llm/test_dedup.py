"""SimHash groups, line units, decontamination and MinHash fingerprints against brute force, with edge cases."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from latencylab.llm import decontaminate, oneperm, simhash, unit_dedup
from latencylab.llm.components import components


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, distance=2):
    """Smallest member of each fingerprint's component, by comparing all pairs."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_matches_its_definition():
    texts = [None, "", " \n", "One", "One two", "A b C d e\tF\x0bg", "É é ÀB\x85c \xa0 d e", "x " * 400, "the cat sat on the mat " * 30]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 64)
    assert simhash.fingerprint(text) == whole


@pytest.fixture(scope="module")
def clusters():
    rnd = np.random.RandomState(0)
    values = {int(v) for v in rnd.randint(0, 2**62, 12)}
    for base in sorted(values)[:3]:
        chain = [base]
        for _ in range(90):
            x = chain[rnd.randint(len(chain))] ^ 1 << int(rnd.randint(0, 62))
            chain.append(x ^ (1 << int(rnd.randint(0, 62)) if rnd.rand() < 0.5 else 0))
        values.update(chain)
    return sorted(values)


@pytest.mark.parametrize("bucket", [2, 48])
def test_links_keep_all_components(spark, clusters, bucket):
    nodes = spark.createDataFrame([(v,) for v in clusters], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, bucket=bucket)).collect()}
    assert {v: roots.get(v, v) for v in clusters} == groups(clusters)


def test_allocation_spends_the_distance():
    total, thresholds = simhash.allocate([[5, 50, 500], [1, 2, 90], [100, 200, 300]], 2)
    assert sum(t + 1 for t in thresholds) == 3 and total == 7 and thresholds == [0, 1, -1]


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i * 31 % 97}" for i in range(200))
    rows = [(5, text, 0), (3, text, 0), (3, text, 0), (9, text.replace("w31", "W31"), 0), (7, None, 0), (8, "", 0), (None, " ", 0), (2, "else", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    found = simhash.with_hex(simhash.near_duplicates(docs)).collect()
    assert len(found) == len(rows)
    component = defaultdict(set)
    for r in found:
        component[r["id"]].add(r["component_id"])
    assert component == {5: {3}, 3: {3}, 9: {3}, 7: {7}, 8: {7}, None: {7}, 2: {2}}
    assert all(r["fingerprint"] == "0" * 16 for r in found if r["id"] in (7, 8, None))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


PASSAGE = (
    "Erouha to handin tiwh onedanble and more wordy here it goes again. Sonlething elsen of the thing, wher it be for ten words. "
    "Anoth sentenc ouh of many ther words in the passag that repeats. Finall sentence of pass goes to the end of here now."
)


def test_passages_go_where_they_repeat(spark):
    rows = [
        (1, f"aaa bbb ccc {PASSAGE} ddd eee", "a", 1), (2, f"xx yy\nzz {PASSAGE.upper()} QQ rr", "b", 2), (3, "Clean one. Text here.", "c", 3),
        (4, None, "d", 4), (5, "", "e", 5), (6, "Clean one. Other words. Text here.", "f", 6), (7, f"{PASSAGE}\n{PASSAGE}", "g", 7),
        (None, "a null id ranks first " * 12, "h", 8), (8, "a null id ranks first " * 12, "i", 9), (9, "!!! ... ???", "j", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept2 string, row int")
    out = {r["row"]: r for r in unit_dedup.dedup(docs).collect()}
    source = {r[3]: r[1] for r in rows}
    assert out[1]["text"] == source[1] and out[3]["text"] == source[3] and out[6]["text"] == source[6] and out[10]["text"] == source[10]
    assert out[2]["text"].lower().startswith("xx yy\nzz ") and "sentenc" not in out[2]["text"].lower()
    assert out[4]["text"] is None and out[4]["kept"] is None and out[5]["text"] == "" and out[5]["kept"] == []
    assert out[7]["text"] == "" and out[8]["text"] == source[8] and out[9]["text"] == ""
    for n, r in out.items():
        if source[n] is not None:
            assert "".join(source[n][k["start"]:k["end"]] for k in r["kept"]) == r["text"]
    assert unit_dedup.dedup(docs.limit(0)).count() == 0


def test_repeats_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen, expected = set(), {}
    for r in docs.orderBy("doc_id").collect():
        text, marked = r["text"] or "", []
        for i, (s, e) in enumerate(zip(*unit_dedup.cut_units(text))):
            plain = unit_dedup.normal_form(text[s:e])
            if plain and plain in seen:
                marked.append(i)
            seen.add(plain)
        expected[r["doc_id"]] = [tuple(x) for x in unit_dedup.kept_spans(text, marked)]
    got = {r["doc_id"]: [tuple(k) for k in r["kept"]] for r in unit_dedup.dedup(docs).collect()}
    assert got == expected


def test_equal_ids_with_different_texts(spark):
    docs = spark.createDataFrame([(1, f"one {PASSAGE}"), (1, f"two {PASSAGE}"), (1, f"two {PASSAGE}")], "doc_id int, text string")
    texts = sorted(r["text"] for r in unit_dedup.dedup(docs).collect())
    assert len(texts) == 3 and sum(PASSAGE[-30:] in t for t in texts) in (1, 2)


ITEM = "Yesterday Alice bought 12 apples and gave 5 kg to Bob before the market closed at 9 hours sharp"


def test_leaks_as_they_stand_and_as_templates(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, "too short", 0), (3, None, 0), (4, "", 0), (5, "one two three four five", 0)], "item_id int, text string, doc_id int")
    rows = [
        (1, f"So: {ITEM.lower()}. More"), (2, f"*** {ITEM}*** ok"),
        (3, "so Carol: yesterday Carol bought 30 apples and gave 7 pounds to Dan before the market closed at 4 hours sharp."),
        (4, None), (5, ""), (6, "Bob is here and nothing else is"), (7, "we count one, two; three four five"), (7, "we count one, two; three four five"),
        (8, "yesterday Alice bought 12 apples then left for good and never gave anything"),
        (None, ITEM),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    found = decontaminate.leaks(docs, items).collect()
    pairs = sorted(((r["id"], r["item_id"]) for r in found), key=str)
    assert pairs == sorted([(1, 1), (2, 1), (3, 1), (7, 5), (None, 1)], key=str)
    assert {r["id"]: r["literal"] for r in found}[3] is False
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == len(rows)


def test_items_of_one_template_are_one_class(spark):
    pattern = "A train covers {} km in {} hours before it stops for water near the old northern bridge"
    items = spark.createDataFrame([(i, pattern.format(100 + i, 2 + i)) for i in range(30)] + [(50, pattern.format(100, 2)), (60, pattern.format(7, 7))], "item_id int, text string")
    docs = spark.createDataFrame([(i, pattern.format(900 + i, 40 + i)) for i in range(20)] + [(99, pattern.format(105, 7)), (98, pattern.format(5, 5))], "doc_id int, text string")
    found = decontaminate.leaks(docs, items).collect()
    by = {}
    for r in found:
        by.setdefault(r["id"], set()).add((r["item_id"], r["literal"], r["n_items"]))
    # other values: the class of the smallest item; equal values are a class of their own, which shares words but no slots
    assert all((0, False, 31) in {(i, False, n) for i, _, n in by[k]} for k in range(20))
    assert all({i for i, _, _ in by[k]} <= {0, 60} for k in range(20))
    assert 5 in {i for i, _, _ in by[99]} and {i for i, _, _ in by[99]} <= {0, 5, 60} and 60 in {i for i, _, _ in by[98]}
    classes = {}
    for r in decontaminate.item_classes(items).collect():
        classes.setdefault(r["item_id"], set()).add(r["first"])
    assert classes[50] == classes[0] == {0} and classes[17] == {0, 17} and classes[60] == {60}


def test_inconsistent_slots_do_not_count(spark):
    item = "then Alice saw Bob and Alice told Bob that Alice would meet Bob near the old mill by noon"
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    same = item.replace("Alice", "Carol").replace("Bob", "Dan")
    mixed = "then Carol saw Dan and Erin told Frank that Grace would meet Heidi near the old mill by noon"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id int, text string")
    assert [r["id"] for r in decontaminate.leaks(docs, items).collect()] == [1]


def test_leaks_against_shared_word_runs(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: __import__("re").findall(r"[^\W\d_]+", (t or "").lower())
    runs = defaultdict(set)
    for r in items.collect():
        w = tokens(r["text"])
        for i in range(len(w) - 7):
            runs[tuple(w[i:i + 8])].add(r["item_id"])
    held = {(r["doc_id"], k) for r in docs.collect() for w in [tokens(r["text"])] for i in range(len(w) - 7) for k in runs.get(tuple(w[i:i + 8]), ())}
    got = {(r["id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got <= held and {d for d, _ in got} == {d for d, _ in held}


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_similarity():
    words = [f"w{i}" for i in range(400)]
    for cut in (0, 40, 100, 200, 400):
        a, b = " ".join(words), " ".join(words[cut:] + [f"v{i}" for i in range(cut)])
        assert abs(oneperm.likeness(oneperm.fingerprint(a), oneperm.fingerprint(b)) - jaccard(a, b)) < 0.13
    assert oneperm.likeness(b"", b"") == 1.0 and oneperm.likeness(b"", oneperm.fingerprint("a")) == 0.0
    assert oneperm.likeness(oneperm.fingerprint("one"), oneperm.fingerprint("two")) < 0.2


def test_against_next_follows_descending_ids(spark):
    rows = [(4, "four is a text with words"), (9, None), (2, "two"), (2, "two"), (1, ""), (7, "x " * 9000), (3, "three é 😀 words here and there")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, n_chars int").repartition(3)
    out = sorted(map(tuple, oneperm.against_next(docs).select("id", "n_chars", "edited_sha256").collect()), key=lambda r: (-r[0], r[2]))
    order = sorted(rows, key=lambda r: -r[0])
    expected = []
    for i, (name, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.append((name, len(text), hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()))
    assert out == sorted(expected, key=lambda r: (-r[0], r[2]))
    assert oneperm.against_next(docs.limit(0)).count() == 0
    alone = oneperm.against_next(docs.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    equal = {bytes(r["fingerprint"]) for r in oneperm.fingerprints(docs.where("doc_id = 2")).collect()}
    assert len(equal) == 1
