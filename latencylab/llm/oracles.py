"""Plain SQL counterparts of the trie and the manifest, by other means: all prefixes listed, levels written out."""

from __future__ import annotations

LEVELS, GROUP_LEVELS = 7, 3  # written out: up to 8^7 rows a group and 8^3 groups


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_concat([ascii(ch)::BIGINT], list_transform(range(8), lambda b: -1::BIGINT))))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def sequence_key(turns: str) -> str:
    each = "length(x.r) || ':' || x.r || length(x.t) || ':' || x.t"
    return f"md5(coalesce(list_aggregate(list_transform({turns}, lambda x: {each}), 'string_agg', ''), ''))"


TRIE = f"""
WITH conv AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT *, {crc32("conv_id::VARCHAR")} % 6 AS h FROM conv),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
  FROM hashed c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (
  SELECT conv_id, len(turns) AS size, d, {sequence_key("turns[1:d]")} AS k, length(turns[d].t) AS chars,
    CASE WHEN d > 0 THEN {sequence_key("turns[1:d - 1]")} END AS parent
  FROM rebuilt, unnest(range(0, len(turns) + 1)) u(d)),
node AS (
  SELECT k, d, parent, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d) AS ends
  FROM prefix GROUP BY k, d, parent),
kids AS (SELECT parent AS k, count(*) AS kids FROM node GROUP BY parent),
counted AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)),
below AS (
  SELECT p.k, count_if(c.kids = 0) AS leaves, sum((c.n - 1) * coalesce(c.chars, 0)) AS saved
  FROM counted c JOIN prefix p ON p.conv_id = c.conv_id AND p.d <= c.d GROUP BY p.k)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n AS n_convs, c.kids AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN below USING (k) LEFT JOIN node up ON up.k = c.parent
"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _levels(name: str, levels: int) -> str:
    """CTEs of the levels above ``<name>0`` (g, pos, h, n), each with the siblings of its nodes as ``l, r``."""
    made = []
    for k in range(levels):
        run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        made.append(f"""{name}{k}s AS (
  SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (
  SELECT g, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, (n + 7) // 8 AS n
  FROM {name}{k} GROUP BY g, pos // 8, n)""")
    return ",\n".join(made)


def _merkle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))
    text = f"CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END"
    joins, steps = [], []
    for name, levels, group, place in (("a", LEVELS, "d.g", "d.pos"), ("b", GROUP_LEVELS, "''", "grp.pos")):
        for k in range(levels):
            steps.append(s := f"{name}{k}s")
            joins.append(f"JOIN {s} ON {s}.g = {group} AND {s}.pos = {place} // {8 ** k}")
    siblings = " || ".join(f"{s}.l || {s}.r" for s in steps)
    folds = [
        f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {s}_n > 1 THEN sha256({s}_l || h || {s}_r) ELSE h END AS h) FROM f{i})"
        for i, s in enumerate(steps)
    ]
    parts = ", ".join(f"{s}.l AS {s}_l, {s}.r AS {s}_r, {s}.n AS {s}_n" for s in steps)
    return f"""
WITH doc AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({head} || {_field("text")}) AS h,
    sha256({head} || {_field("tampered")}) AS tampered
  FROM (SELECT *, {text} AS tampered FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM doc),
a0 AS (SELECT g, pos, h, n FROM placed),
{_levels("a", LEVELS)},
grp AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{LEVELS}),
b0 AS (SELECT '' AS g, pos, h, n FROM grp),
{_levels("b", GROUP_LEVELS)},
f0 AS (
  SELECT d.doc_id, d.h AS leaf, grp.h AS subroot, top.h AS root, sha256({siblings}) AS proof_sha256, d.tampered AS h, {parts}
  FROM placed d JOIN grp ON grp.g = d.g {" ".join(joins)} JOIN b{GROUP_LEVELS} top ON true),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM f{len(steps)}
"""


MERKLE = _merkle()
