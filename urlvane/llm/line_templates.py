"""Line dedup with a log-template tree of fixed depth, on built-in DataFrame functions only.

A line goes to the leaf given by its number of tokens and its leading tokens; tokens that hold a
digit count as variable everywhere. Within a leaf a token is a fixed part of the template if
another line has it at the same place, else it is a variable field. A template that recurs in
enough documents, in various surroundings, is boilerplate, and its lines are dropped. Lines that
recur between the same neighbours belong to copies of whole documents and stay for other operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from urlvane.llm.shared import discard, fresh, written

#: Leading tokens on the way to a leaf.
DEPTH = 3
#: At least this part of a line must be fixed for the line to take a generalised template.
FIXED_SHARE = 0.5
MIN_DOCS = 5
#: A recurring template has its commonest neighbourhood in at most this part of its documents.
SAME_PLACE = 0.5
VARIABLE = "<*>"
_WITH_DIGIT = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _tokens(line: Column) -> Column:
    # costly patterns only for lines that need them; a split by one space takes no pattern at all
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _WITH_DIGIT, VARIABLE)).otherwise(line)
    plain = F.when(line.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(plain, r"\s+", " ")).otherwise(plain)
    return F.array_remove(F.split(plain, " "), "")


def _parsed(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The tokens of rows with a line's text, its leaf and line (hash of its tokens)."""
    # one step, so that tokens are made once
    rows = lines.select(*keep, F.explode(F.array(_tokens(F.col("text")))).alias("tokens"))
    lead = [F.get("tokens", F.lit(i)) for i in range(DEPTH)]
    return rows.select(*keep, "tokens", F.xxhash64(F.size("tokens"), *lead).alias("leaf"),
                       F.xxhash64(F.size("tokens"), "tokens").alias("line"))


def _row_mark() -> Column:
    """Names a row by its id and text, also where the id is null or repeated. Rows that share it by chance do no harm."""
    return F.xxhash64("doc_id", "text").alias("mark")


def parsed_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has a token: doc_id, mark (of its row), line_no, leaf, line (hash of its tokens), place (hash of its neighbours)."""
    arrays = docs.select("doc_id", _row_mark(), _lines("text").alias("lines")).filter("lines IS NOT NULL")
    arrays = arrays.select("doc_id", "mark", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("marks"))
    rows = arrays.select("doc_id", "mark", "marks", F.posexplode("lines").alias("line_no", "text")).filter(F.col("text").rlike(r"\S"))
    place = F.xxhash64(F.get("marks", F.col("line_no") - 1), F.lit("|"), F.get("marks", F.col("line_no") + 1))
    return _parsed(rows.select("doc_id", "mark", "line_no", "text", place.alias("place")), ["doc_id", "mark", "line_no", "place"]).drop("tokens")


def templates(docs: DataFrame, lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """line and template (hashes) for lines that share a leaf with another one and are fixed for the greater part.

    Also the scratch tables that may go once the rows have been read.
    """
    heads = lines.groupBy("leaf", "line").agg(F.min(F.struct("mark", "line_no")).alias("at"))
    heads = written(heads.select("leaf", "line", "at.*"), "line-heads")
    shared = heads.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")
    wanted = heads.join(shared, "leaf", "left_semi").select("mark", "line_no", F.col("line").alias("wanted"))
    texts = docs.select(_row_mark(), F.posexplode(_lines("text")).alias("line_no", "text")).filter(F.col("text").rlike(r"\S"))
    # text moves as it is, and only wanted lines are cut into tokens again
    found = _parsed(texts.join(wanted, ["mark", "line_no"]), ["wanted"]).filter(F.col("line") == F.col("wanted"))
    tokens = found.dropDuplicates(["leaf", "line"]).select("leaf", "line", F.posexplode("tokens").alias("at", "token"))
    tokens = written(tokens, "line-tokens")
    seen = tokens.groupBy("leaf", "at", "token").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf", "at", "token")
    marked = tokens.join(seen.withColumn("fixed", F.lit(1)), ["leaf", "at", "token"], "left")
    part = F.struct("at", F.when(F.col("fixed") == 1, F.col("token")).otherwise(VARIABLE).alias("token"))
    built = marked.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("fixed").alias("fixed"), F.count("*").alias("n"))
    return built.filter(F.col("fixed") >= FIXED_SHARE * F.col("n")).select(
        "leaf", "line", F.xxhash64("leaf", F.col("parts.token")).alias("template")), [heads, tokens]


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same_place: float = SAME_PLACE) -> DataFrame:
    """doc_id and line_no of all lines whose template recurs in at least min_docs documents and various places."""
    lines = written(parsed_lines(docs), "lines")
    found, scratch = templates(docs, lines)
    named = lines.join(found, ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line"))
    named = written(named.select("doc_id", "line_no", "template", "place"), "line-templates")
    discard(lines, *scratch)
    placed = named.select("template", "place", "doc_id").distinct().groupBy("template", "place").agg(F.count("*").alias("docs"))
    all_docs = named.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    common = placed.groupBy("template").agg(F.max("docs").alias("in_one_place"))
    drop = all_docs.filter(F.col("docs") >= min_docs).join(common, "template").filter(
        F.col("in_one_place") <= same_place * F.col("docs"))
    return named.join(drop.select("template"), "template", "left_semi").select("doc_id", "line_no")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, same_place: float = SAME_PLACE) -> DataFrame:
    """The documents without recurring lines, with n_lines and n_dropped; other columns stay as they are.

    Line feeds part lines; lines of white space are never dropped. A null text stays null with 0 lines. A document
    may be left with an empty text. Rows with equal ids count as one document, and lose lines by their numbers together;
    a null id loses none, but its lines count as those of one document. An empty table gives no rows. Other columns may have
    any names; n_lines and n_dropped are replaced.
    """
    key, lost, all_lines = (fresh(docs, name) for name in ("id", "gone", "lines"))
    taken = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    gone = recurring_lines(docs, min_docs, same_place).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(lost))
    lines = F.coalesce(F.size(_lines("text")), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines("text")) - 1), lost)
    text = F.when(F.col(lost).isNull() | F.col("text").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(all_lines), i)), "\n"))
    rows = docs.join(gone, docs["doc_id"] == F.col(key), "left").withColumn(all_lines, _lines("text"))
    return rows.select(*taken, text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"),
                       F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(lost), F.lit(0))).alias("n_dropped"))
