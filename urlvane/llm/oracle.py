"""SQL with the results of the queries, where SQL can express them."""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    data = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: {bits}), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _manifest(levels: int, source_levels: int) -> str:
    """The tree, level by level. A source holds at most 16 ** levels rows; there are at most 16 ** source_levels sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    id_text = "coalesce(CAST(doc_id AS VARCHAR), '')"
    ctes = [
        f"hashed AS (SELECT doc_id, source, {leaf('text')} AS node, CASE WHEN {_crc32(id_text)} % 5 = 0 THEN {leaf(_LOWER.format('text'))} END AS altered FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM hashed)",
        "n0 AS (SELECT source AS g, i, node FROM leaves)",
    ]

    def rise(name: str, count: int) -> None:
        for k in range(count):
            ctes.append(
                f"{name}p{k} AS (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(node, '') OVER (PARTITION BY g, i // 16 ORDER BY i "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER (PARTITION BY g, i // 16 ORDER BY i "
                f"ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) "
                        f"ELSE any_value(node) END AS node FROM {name}p{k} GROUP BY g, i // 16)")

    rise("n", levels)
    ctes.append(f"s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, node, g AS source FROM n{levels})")
    rise("s", source_levels)
    ctes.append("f0 AS (SELECT *, coalesce(altered, node) AS fold, '' AS proof FROM leaves)")
    step = "CASE WHEN p.n > 1 THEN sha256(p.l || fold || p.r) ELSE fold END AS fold, proof || CASE WHEN p.n > 1 THEN p.l || p.r ELSE '' END AS proof"
    for k in range(levels):
        ctes.append(f"f{k + 1} AS (SELECT f.* EXCLUDE (fold, proof), {step} FROM f{k} f JOIN np{k} p ON p.g IS NOT DISTINCT FROM f.source AND p.i = f.i // {16 ** k})")
    ctes.append(f"t0 AS (SELECT f.*, s.i AS j, s.node AS subroot FROM f{levels} f JOIN s0 s ON s.source IS NOT DISTINCT FROM f.source)")
    for k in range(source_levels):
        ctes.append(f"t{k + 1} AS (SELECT f.* EXCLUDE (fold, proof), {step} FROM t{k} f JOIN sp{k} p ON p.i = f.j // {16 ** k})")
    return "WITH " + ",\n".join(ctes) + f"""
    SELECT t.doc_id, t.node AS leaf, subroot, s.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = s.node AS verified
    FROM t{source_levels} t CROSS JOIN s{source_levels} s"""


_SPELLING = f"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("key")} AS h FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS other FROM places),
holes AS (SELECT word, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS hole FROM places),
pairs AS (SELECT l.word, l.other FROM less l JOIN words w ON w.word = l.other
  UNION SELECT l.other, l.word FROM less l JOIN words w ON w.word = l.other
  UNION SELECT a.word, b.word FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word),
best AS (SELECT p.word, count(*) AS n_near, first(p.other ORDER BY w.n DESC, p.other) AS other, max(w.n) AS most
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.other END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

STATEMENTS: dict[str, str] = {"op12_spelling": _SPELLING, "op13_manifest": _manifest(5, 4)}
