"""WARC archives, main text, reply trees and language models, with edge cases."""

import gzip
import hashlib

import numpy as np
import pytest

from latencylab.llm import langid, queries, reply_trees, warc, wrappers


def test_url_keys():
    assert warc.url_key("https://user@WWW.Example.com:8080/a b?q=1#f") == "com,example,www:8080)/a%20b?q=1"
    assert warc.url_key("http://example.com:80") == "com,example)/" and warc.url_key(None) == "" == warc.url_key("")


def test_archive_round_trip(spark):
    big, other = "<p>" + "é" * 60, "x" * 100
    rows = [(5, "http://a.example/1", big), (3, "http://a.example/2", big), (8, "http://b.example/", big), (2, None, None), (1, "", ""), (6, "http://a.example/1", "short"),
            (7, "http://a.example/1", "short"), (9, "odd url\n", other), (9, "odd url\n", other), (None, "http://c.example", other), (10, "http://z.example", "y" * 300000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    out = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    expected = []
    for name, _, page in rows:
        data = (page or "").encode()
        first = min((r[0] for r in rows if r[0] is not None and r[2] == page), default=None) if len(data) >= 100 else None
        again = first is not None and first != name
        expected.append((name, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert out == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lookup_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example/{i % 7}", f"page {i}") for i in range(40)], "page_id bigint, url string, html string")
    shards = warc.archive(pages)
    urls = spark.createDataFrame([("http://h1.example/1",), ("HTTP://H2.example/3#x",), ("http://nowhere.example/",), (None,)], "url string")
    found = warc.lookup(shards, urls)
    got = sorted((r["url"], r["id"]) for r in found.collect())
    assert got == sorted([("http://h1.example/1", i) for i in range(40) if i % 5 == 1 and i % 7 == 1] + [("HTTP://H2.example/3#x", i) for i in range(40) if i % 5 == 2 and i % 7 == 3])
    assert warc.read_records(found).count() == len(got)


def test_a_key_of_most_captures_is_spread_over_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, "http://hot.example/", f"page {i}") for i in range(50)] + [(100 + i, f"http://{c}.example/", "x") for i, c in enumerate("aghiz")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    shards = warc.archive(pages)
    keys = warc.url_keys(pages).select("key").distinct()
    found = warc.search(shards, keys)
    assert sorted(r["id"] for r in found.collect()) == sorted(r[0] for r in rows)
    for url, ids in (("http://hot.example/", set(range(50))), ("http://a.example", {100}), ("http://zz.example/", set())):
        assert {r["id"] for r in warc.search(shards, warc.url_keys(spark.createDataFrame([(url,)], "url string"))).collect()} == ids
    assert sorted(r["page_id"] for r in warc.round_trip(pages).collect()) == sorted(r[0] for r in rows)


def test_revisits_are_held_against_the_record_they_name(spark):
    rows = [(1, 200, "aa", "response", None, "u"), (2, 200, "aa", "revisit", 1, "u")]
    kind = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    assert warc.verified(spark.createDataFrame(rows, kind)).count() == 2
    bad = spark.createDataFrame([*rows, (3, 201, "aa", "revisit", 1, "u")], kind)
    with pytest.raises(Exception, match="revisit 3 doesn't agree"):
        warc.verified(bad).collect()


def test_records_are_gzip_members():
    page = {"id": 4, "url": "u", "digest": "d", "bytes": 2, "refers_to": None, "payload": b"hi"}
    data = warc.record(page)
    assert gzip.decompress(data).startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and gzip.decompress(data).endswith(b"hi\r\n\r\n")
    assert warc.parse(data)["payload"] == b"hi"


PAGE = """<html><body class="no-sidebar"><header><h1>Site</h1></header><div class="wrap"><nav>menu</nav><article><header class="entry-header"><h1>Title &amp;
 more {n}</h1></header><p>One<br>two <b>bold</b>{n}<p>Three&nbsp;x<div class="ad">buy</div><ul><li>a{n}<li>b</ul><form>f<input></form><script>var a="<p>no</p>"</script></article>
<section id="comments"><article class="comment"><p>nice</p></article></section></div><aside>s</aside><div class="cookie-notice">c</div><footer>f</footer>"""
TEXT = "Title & more {n}\n\nOne two bold{n}\n\nThree x\n\na{n}\n\nb"


def test_main_text_leaves_out_the_rest():
    assert wrappers.main_text(PAGE.replace("{n}", "1"), None, [], -1) == TEXT.replace("{n}", "1")
    odd = {"": "", "<p>": "", "plain  text": "plain text", "<div>a<div>b</div>c</div>": "a\n\nb\n\nc", '<p a="x>open': "open", "<b>" * 500 + "deep": "deep", "<!-- x": "", "<script>never": ""}
    assert {k: wrappers.main_text(k, None, [], -1) for k in odd} == odd


def test_matching_counts_common_nodes():
    a, b = (wrappers.dom(x) for x in ("<div><p>x</p><ul><li>1<li>2</ul></div>", "<div><h1>t</h1><p>y</p><ul><li>1</ul><p>z</p></div>"))
    wrappers.numbered(a), wrappers.numbered(b)
    pairs = wrappers.Matching().pairs(a, b)
    matching = wrappers.Matching()
    assert matching.size(matching.shape(a), matching.shape(b)) == len(pairs) == 5
    assert all(x.label == y.label for x, y in pairs)


def naive_size(a, b):
    """Simple tree matching as it is defined, by recursion over all prefixes."""
    if a.label != b.label:
        return 0
    left, right = a.elements(), b.elements()
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + naive_size(x, y))
    return best[-1][-1] + 1


def random_tree(rnd, depth):
    node = wrappers.Node(rnd.choice("ab"))
    if depth:
        node.kids = [random_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return node


@pytest.mark.parametrize("cells", [1, 4_000_000])
def test_matching_is_the_largest_order_preserving_one(monkeypatch, cells):
    import random

    monkeypatch.setattr(wrappers, "WHOLE_TABLE", cells)
    rnd = random.Random(cells)
    for _ in range(150):
        a, b = random_tree(rnd, 3), random_tree(rnd, 3)
        b.tag = b.label = a.label
        pairs = wrappers.Matching().pairs(a, b)
        assert len(pairs) == naive_size(a, b)
        parent = {id(k): n for t in (a, b) for n in wrappers.numbered(t) for k in n.elements()}
        partner = {id(x): y for x, y in pairs}
        assert len(partner) == len({id(y) for _, y in pairs}) == len(pairs)
        for x, y in pairs:
            assert x.label == y.label and (x is a or partner[id(parent[id(x)])] is parent[id(y)])
        order = sorted(pairs, key=lambda p: p[0].number)
        for n in wrappers.numbered(a):
            mine = [partner[id(k)].number for k in n.elements() if id(k) in partner]
            assert mine == sorted(mine)
        assert order[0] == (a, b)


def test_long_and_deep_pages():
    import time

    many = "<div>" + "<p>x</p><p>y <b>z</b></p>" * 15_000 + "</div>"
    other = "<div><h1>t</h1>" + "<p>x <b>q</b></p><p>w</p>" * 15_000 + "</div>"
    began = time.time()
    a, b = wrappers.dom(many), wrappers.dom(other)
    wrappers.numbered(a), wrappers.numbered(b)
    assert len(wrappers.Matching().pairs(a, b)) > 44_990
    assert time.time() - began < 60
    deep = "<div>" * 20_000 + "<nav>MENU</nav><p>text</p>" + "</div>" * 20_000 + "<p>after</p>"
    assert wrappers.main_text(deep, None, [], -1) == "text\n\nafter"
    root = wrappers.dom(deep)
    wrappers.numbered(root)
    assert wrappers.main_text(deep, root, [], 0) == "text\n\nafter"


def test_wrapper_decides_without_telling_tags_and_names(spark, sf_dir):
    """The given pages with their menus, adverts, articles and footers as divs of meaningless names."""
    import re

    import duckdb

    rows = duckdb.sql(f"select page_id, url, html from '{sf_dir}/pages.parquet'").fetchall()
    tag = {"nav": "k1", "article": "q7", "footer": "z3"}

    def disguised(page):
        page = (page or "").replace('class="ad"', 'class="m5"')
        for name, label in tag.items():
            page = re.sub(f"<{name}>", f'<div class="{label}">', page).replace(f"</{name}>", "</div>")
        return page

    # one host, so that there is enough to compare
    plain = spark.createDataFrame([(i, "http://one.example/", h) for i, _, h in rows], "page_id bigint, url string, html string")
    hidden = spark.createDataFrame([(i, "http://one.example/", disguised(h)) for i, _, h in rows], plain.schema)
    want = {r["id"]: r["text"] for r in wrappers.extract(plain).collect()}
    got = {r["id"]: r["text"] for r in wrappers.extract(hidden).collect()}
    alone = {i: wrappers.main_text(disguised(h), None, [], -1) for i, _, h in rows}
    assert got == want
    assert sum(alone[i] != want[i] for i in want) > 0.9 * len(want)  # tags and names alone print menus and adverts


def test_wrapper_learns_slot_and_template(spark):
    plain = "<html><body><div><span>Brand line</span></div><div><p>Same intro</p><p>Text {n} of its own {n}</p><p>More {n}</p></div><div>Fixed end</div></body></html>"
    rows = [(i, f"http://one.example/{i}", plain.replace("{n}", f"no{i}"), 0) for i in range(20)]
    rows += [(90, "http://two.example/", PAGE.replace("{n}", "9"), 0), (91, None, None, 0), (None, "odd", "", 0), (92, "http://one.example/x", "<article>else</article>", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = {r["id"]: r for r in wrappers.extract(pages).collect()}
    assert len(out) == len(rows)
    assert out[4]["text"] == "Text no4 of its own no4\n\nMore no4" and out[4]["n_chars"] == len(out[4]["text"])
    assert out[90]["text"] == TEXT.replace("{n}", "9") and out[91]["text"] == "" == out[None]["text"] and out[92]["text"] == "else"
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_best_paths_of_a_tree(spark):
    rows = [(1, "a", None, "user", "q", 0.0), (1, "b", "a", "assistant", "x", 1.0), (1, "c", "a", "assistant", "y", 2.0), (1, "d", "c", "user", "z", -5.0),
            (1, "e", "c", "user", "zz", 3.0), (2, "q", "gone", "user", "only", None), (None, "n", None, "user", "none", 1.0)]
    messages = spark.createDataFrame(rows, "conv_id int, node string, parent string, role string, text string, score double")
    found = reply_trees.paths(messages, best=2).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r["position"]):
        paths.setdefault((r["conv_id"], r["rank"]), []).append(r["node"])
    assert paths == {(1, 1): ["a", "c", "e"], (1, 2): ["a", "b"], (2, 1): ["q"], (None, 1): ["n"]}
    assert reply_trees.paths(messages.limit(0)).count() == 0


def test_long_chain_and_cycle(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i)) for i in range(300)], "conv_id int, node int, parent int, role string, text string")
    found = reply_trees.paths(chain).orderBy("position").collect()
    assert [r["node"] for r in found] == list(range(300)) == [r["position"] for r in found]
    ring = spark.createDataFrame([(1, 1, 2, "user", ""), (1, 2, 1, "user", "")], chain.schema)
    with pytest.raises(ValueError):
        reply_trees.MAX_DOUBLINGS, kept = 4, reply_trees.MAX_DOUBLINGS
        try:
            reply_trees.paths(ring)
        finally:
            reply_trees.MAX_DOUBLINGS = kept


def test_chats_read_back_whole(spark):
    odd = ["<|im_end|>", "<\\|im_start|>", "a<|b<\\\\|c", None, "", "line\nline", "é😀 " * 3000]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(odd)]
    rows += [(2, 5, "ro\\le\n<|x", "later", 0), (2, None, None, "first", 0), (3, 1, "user", "same", 0), (3, 1, "user", "same", 0), (None, 0, "assistant", "lost", 0)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, piece int")
    out = {r["conv_id"]: r for r in reply_trees.round_trip(turns).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert out[conv]["n_turns"] == len(mine) and out[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert out[conv]["loss_chars"] == len(loss) and out[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r["conv_id"]: r["text"] for r in reply_trees.format_trees(reply_trees.as_chains(turns)).collect()}
    assert len(whole) == 4 and whole[1].count("<|") == 2 * len(odd)  # nothing but the marks
    for chunk in (1, 7, 1000):
        cut = reply_trees.format_trees(reply_trees.as_chains(turns), chunk=chunk)
        assert {r["conv_id"]: tuple(r) for r in reply_trees.read_back(cut).collect()} == {k: (v[0], 1, *v[1:]) for k, v in out.items()}
    assert reply_trees.round_trip(turns.limit(0)).count() == 0


def test_turns_are_found_by_their_marks_only():
    reader = reply_trees.TurnReader()
    text = "<|im_start|>user\na<\\|im_end|>\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [t for c in text for t in reader.feed(c)] == [("user", "a<|im_end|>\nb"), ("assistant", "")]
    reader.close()
    for bad in ("x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na"):
        with pytest.raises(ValueError):
            reader = reply_trees.TurnReader()
            list(reader.feed(bad))
            reader.close()


def test_ranked_branches_against_enumeration(spark):
    """Random trees: every root-to-leaf path, ranked by mean score, then formatted and read back."""
    import random

    rnd, rows = random.Random(11), []
    for conv in range(12):
        for n in range(rnd.randint(1, 40)):
            parent = rnd.choice([None, *range(n)]) if n and rnd.random() < 0.15 else rnd.randrange(n) if n else None
            rows.append((conv, n, parent, rnd.choice(["user", "assistant"]), rnd.choice(["a", "<|im_end|>\n", "", "é" * 30]), rnd.choice([None, 1.0, 2.0, 5.0])))
    best, expected = 3, {}
    for conv in range(12):
        mine = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in mine.values()}
        found = []
        for leaf in (n for n in mine if n not in inner):
            path = [leaf]
            while mine[path[-1]][2] is not None:
                path.append(mine[path[-1]][2])
            found.append((-sum(mine[n][5] or 0 for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(found)[:best], 1):
            expected[conv, rank] = [(mine[n][3], mine[n][4]) for n in path]
    messages = spark.createDataFrame(rows, "conv_id int, node int, parent int, role string, text string, score double").repartition(5)
    out = {(r["conv_id"], r["rank"]): r for r in reply_trees.read_back(reply_trees.format_trees(messages, best, chunk=50)).collect()}
    assert set(out) == set(expected)
    for key, turns in expected.items():
        assert out[key]["n_turns"] == len(turns)
        assert out[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[key]["loss_sha256"] == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def test_kneser_ney_sums_to_one():
    model = langid.train(["abab", "abc", "cab", "b"], np.array([3, 2, 1, 1]))
    alphabet = ["a", "b", "c", langid.END]
    for context in ("", "a", "ab", "ca", "abab"):
        total = 0.0
        for letter in alphabet:
            codes = np.array([ord(x) for x in (langid.START * 4 + context + letter)], np.uint64)
            hashes = langid.grams(codes)
            keys = [h[-1:] for h in hashes]
            contexts = [np.zeros(1, np.uint64), *[h[-2:-1] for h in hashes[:-1]]]
            total += np.exp(langid.log_probabilities(model, keys, contexts)[0])
        assert 0.9 < total < 1.0  # the rest is left to unseen symbols


def plain_kneser_ney(words: dict[str, int], order: int = langid.ORDER):
    """Interpolated Kneser-Ney from dictionaries: counts at the top, numbers of left neighbours below."""
    top = {}
    for word, n in words.items():
        text = langid.START * (order - 1) + word + langid.END
        for i in range(order - 1, len(text)):
            gram = text[i - order + 1:i + 1]
            top[gram] = top.get(gram, 0) + n
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        below = {}
        for gram in levels[n + 1]:
            below[gram[1:]] = below.get(gram[1:], 0) + 1
        levels[n] = below

    def probability(context: str, symbol: str) -> float:
        p = 1.0 / (len(levels[1]) + 1)
        for n in range(1, order + 1):
            counts = levels[n]
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            head = context[len(context) - n + 1:]
            after = {g: c for g, c in counts.items() if g[:-1] == head}
            if not after:
                return p
            total = sum(after.values())
            p = max(after.get(head + symbol, 0) - discount, 0) / total + discount * len(after) / total * p
        return p

    return probability


def test_kneser_ney_against_plain_dictionaries():
    words = {"abab": 3, "abc": 2, "cab": 1, "b": 4, "éa": 1, "abcab": 2}
    model = langid.train(list(words), np.array(list(words.values())))
    direct = plain_kneser_ney(words)
    for context in ("", "a", "ab", "ca", "abab", "z", "az", "éa", "bcab"):
        for symbol in ["a", "b", "c", "é", "z", langid.END]:
            padded = (langid.START * 4 + context)[-4:]
            codes = np.array([ord(x) for x in padded + symbol], np.uint64)
            hashes = langid.grams(codes)
            keys, contexts = [h[-1:] for h in hashes], [np.zeros(1, np.uint64), *[h[-2:-1] for h in hashes[:-1]]]
            assert np.exp(langid.log_probabilities(model, keys, contexts)[0]) == pytest.approx(direct(padded, symbol), rel=1e-9)


def test_languages_are_told_apart(spark, sf_dir):
    out = queries.QUERIES["op7_language"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in out.join(truth, "doc_id").collect() if r["held_out"]]
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_words_are_scored_whole():
    models = [langid.train(["abab", "abc", "cab", "b"], np.array([3, 2, 1, 1])), langid.train(["xyz", "zyx"], np.array([2, 1]))]
    word = "abcab" * 300
    sums, sizes = langid.Scorer(models)([word, "abc", f"abc {word}, 12"])
    direct, n = langid.score_words(models, [word, "abc"])
    assert sizes.tolist() == [n[0], n[1], n[0] + n[1]] and np.allclose(sums[:2], direct) and np.allclose(sums[2], direct.sum(0))


def test_language_edges(spark):
    english, german = "the cat sat on the mat with the other cats ", "der hund lief durch die stadt und bellte laut "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", 0.0) for i in range(24)]
    rows += [(50, None, "en", 0.0), (51, "", "de", 0.0), (52, "123 ² !!", None, 0.0), (None, "the mat", None, 0.0), (53, "the hats " * 9000, None, 0.0), (54, "ж" * 900, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    known = langid.fit(docs)
    out = {r["id"]: r for r in langid.identify(docs, known).collect()}
    assert len(out) == len(rows) and out[1]["lang_pred"] == "en" and out[2]["lang_pred"] == "de" and out[None]["lang_pred"] == "en"
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 and not out[k]["accepted"] for k in (50, 51, 52))
    assert out[53]["lang_pred"] == "en" and not out[54]["accepted"]
    kept = langid.accepted_rows(docs, known)
    assert kept.columns == docs.columns and {50, 51, 52, 54}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = langid.fit(docs.limit(0))
    assert [r["lang_pred"] for r in langid.identify(docs.where("doc_id = 1"), nothing).collect()] == ["und"]
