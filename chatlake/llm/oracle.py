"""DuckDB SQL of the queries on repeats, spelling and the manifest."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit (3988292384 is its reversed polynomial)."""
    h = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_transform(range(4 * length({h})), lambda i: CASE WHEN i % 8 = 0 THEN "
            f"CAST('0x' || substr({h}, 2 * (i // 8) + 1, 2) AS BIGINT) ELSE 0 END), "
            "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), 4294967295), 4294967295)")


OP11 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i,
         unnest([array_to_string(w[i:i + 19], ' ') for i in generate_series(1, len(w) - 19)]) AS s
  FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM places QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS k FROM later),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP12 = rf"""WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UP}', '{_LOW}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM counted),
v AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
shorter AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word FROM shorter s JOIN v ON s.rest = v.word
  UNION SELECT v.word, s.word FROM shorter s JOIN v ON s.rest = v.word),
best AS (
  SELECT pairs.word, other, v.n AS other_n, count(*) OVER (PARTITION BY pairs.word) AS n_near
  FROM pairs JOIN v ON v.word = other QUALIFY row_number() OVER (PARTITION BY pairs.word ORDER BY v.n DESC, other) = 1),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _manifest(group_levels: int = 7, top_levels: int = 3) -> str:
    """Trees of up to 8**7 rows a group and 8**3 groups, level by level."""
    cut = "sha256(string_agg(h, '' ORDER BY i))"
    parts = [f"""leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UP}', '{_LOW}')")} ELSE {_leaf("text")} END AS given
  FROM documents)""",
             "g0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves)"]

    def level(t, k, key):
        beside = f"PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN"
        parts.append(f"""{t}{k}s AS (
  SELECT {key}, i, count(*) OVER (PARTITION BY {key}) > 1 AS many, coalesce(string_agg(h, '') OVER ({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER ({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k})""")
        parts.append(f"""{t}{k + 1} AS (
  SELECT {key}, i // 8 AS i, CASE WHEN any_value(many) THEN {cut} ELSE any_value(h) END AS h
  FROM {t}{k} JOIN (SELECT {key}, count(*) > 1 AS many FROM {t}{k} GROUP BY {key}) USING ({key}) GROUP BY {key}, i // 8)""")

    for k in range(group_levels):
        level("g", k, "g")
    parts.append(f"t0 AS (SELECT 0 AS o, g AS i, h FROM g{group_levels})")
    for k in range(top_levels):
        level("t", k, "o")
    parts.append("f0 AS (SELECT doc_id, g, i, leaf, given AS f, '' AS p FROM g0)")
    step = "CASE WHEN many THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN many THEN p || l || r ELSE p END AS p"
    for k in range(group_levels):
        parts.append(f"f{k + 1} AS (SELECT doc_id, g, i // 8 AS i, leaf, {step} FROM f{k} JOIN g{k}s USING (g, i))")
    parts.append(f"u0 AS (SELECT doc_id, g, g AS i, leaf, f, p FROM f{group_levels})")
    for k in range(top_levels):
        parts.append(f"u{k + 1} AS (SELECT doc_id, g, i // 8 AS i, leaf, {step} FROM u{k} JOIN t{k}s USING (i))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM u{top_levels} JOIN g{group_levels} s USING (g) CROSS JOIN t{top_levels} t
"""


OP13 = _manifest()
