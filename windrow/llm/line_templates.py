"""Line deduplication with a log-template tree of fixed depth.

A line descends by its token count and its leading tokens (variable tokens masked) to a leaf.  At the leaf its remaining tokens are
its template, in which variable fields are generalised: tokens with a digit always, and besides any one of ``fields`` contiguous
stretches of the tail.  Two lines share a template if they agree in path and tail up to the generalised field.  This states the
tree's matching as equality of keys, so the result does not depend on the order in which lines arrive, and leaves are grouped,
never walked: no leaf sits in one task.  Templates that recur across documents are dropped but for their first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import BLANK, fresh, stored, whole_text

LEADING, FIELDS, MIN_TOKENS, MIN_GENERAL, MIN_DOCS = 3, 4, 5, 8, 2
MASK = "<*>"


def line_nodes(text: Column, leading: int, fields: int, min_tokens: int, min_general: int, exact: bool = False) -> Column:
    """Array over the lines of struct(leaf, keys): the leaf's path hash and the hashes of the line's templates.

    keys holds the masked template and, from ``min_general`` tokens on, one more for each generalised field.  A template must
    keep at least half its tokens constant; lines below ``min_tokens`` tokens have none.  With ``exact`` a line with a token but without a
    masked template has the hash of its tokens as they are.
    """
    lines = F.split(text, "\n")
    tokens = F.transform(lines, lambda x: F.filter(F.split(x, f"[{BLANK}]+"), lambda t: t != ""))
    mask = lambda x: F.transform(x, lambda t: F.when(t.rlike("[0-9]"), MASK).otherwise(t))
    # the hash of a line's own tokens goes along with them: a lambda that reads another array computes all of it for every line
    masked = F.transform(tokens, lambda x: F.struct(mask(x).alias("x"), F.xxhash64(F.lit("exact"), x).alias("own")) if exact else F.struct(mask(x).alias("x")))

    def parts(line: Column) -> Column:
        x = line["x"]
        n = F.size(x)
        tail = F.greatest(n - leading, F.lit(0))
        edges = [F.lit(leading) + F.floor(tail * i / fields).cast("int") for i in range(fields + 1)]
        own = [F.slice(x, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(fields)]
        return F.struct(
            n.alias("n"), F.xxhash64(n, F.slice(x, 1, leading)).alias("leaf"), F.size(F.filter(x, lambda t: t == MASK)).alias("masked"),
            *([line["own"]] if exact else []),
            *[F.xxhash64(p).alias(f"h{i}") for i, p in enumerate(own)], *[F.size(F.filter(p, lambda t: t != MASK)).alias(f"c{i}") for i, p in enumerate(own)])

    def node(s: Column) -> Column:
        constant = s["n"] - s["masked"]
        keys = [F.when(constant * 2 >= s["n"], F.xxhash64(s["leaf"], *[s[f"h{i}"] for i in range(fields)]))]
        for skip in range(fields):
            keys.append(F.when((s["n"] >= min_general) & ((constant - s[f"c{skip}"]) * 2 >= s["n"]),
                               F.xxhash64(F.lit(skip), s["leaf"], *[s[f"h{i}"] for i in range(fields) if i != skip])))
        found = F.when(s["n"] >= min_tokens, F.filter(F.array(*keys), lambda k: k.isNotNull()))
        if exact:
            # lines with a masked template need no key of their own: equal tokens have equal templates
            none, templated = F.array().cast("array<bigint>"), (s["n"] >= min_tokens) & (constant * 2 >= s["n"])
            found = F.concat(F.coalesce(found, none), F.when((s["n"] > 0) & ~templated, F.array(s["own"])).otherwise(none))
        return F.struct(s["leaf"].alias("leaf"), found.alias("keys"))

    return F.transform(F.transform(masked, parts), node)


def repeated_lines(docs: DataFrame, id_column: str, text_column: str, leading: int, fields: int, min_tokens: int, min_general: int, min_docs: int,
                   exact: bool = False) -> DataFrame:
    """(_id, _h, dropped): per document with lines to drop their numbers from 0, at most the document's own lines."""
    text = whole_text(text_column)
    nodes = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_h"), F.posexplode(line_nodes(text, leading, fields, min_tokens, min_general, exact)).alias("line", "s"))
    lines = stored(nodes.where(F.size("s.keys") > 0).select("_id", "_h", "line", "s.leaf", "s.keys"), "template-lines")
    # a leaf with one line holds no recurring template
    # (grouped sides are stored, so that a hot leaf or template meets them in a join whose large partitions Spark splits)
    leaves = stored(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf"), "recurring-leaves")
    met = lines.join(leaves, "leaf").select("_id", "_h", "line", F.explode("keys").alias("key"))
    occurrences = met.groupBy("key", "_id").agg(F.min("line").alias("line"))
    templates = stored(occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("_id", "line")).alias("first")).where(F.col("docs") >= min_docs), "recurring-templates")
    late = met.join(templates, "key").where(F.struct("_id", "line") > F.col("first")).select("_id", "_h", "line")
    return late.where("_id IS NOT NULL").groupBy("_id", "_h").agg(F.collect_set("line").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", leading: int = LEADING, fields: int = FIELDS, min_tokens: int = MIN_TOKENS,
                        min_general: int = MIN_GENERAL, min_docs: int = MIN_DOCS, exact: bool = False) -> DataFrame:
    """``docs`` with the later lines of every recurring template removed from ``text_column``, and n_lines, n_dropped beside.

    A template recurs if at least ``min_docs`` ids have it; a line is dropped if an earlier line, by id and then line number,
    has one of its recurring templates.  So one line of each template stays and a copied document leaves its content in the
    first copy.  Lines are separated by a line feed; blank lines and lines below ``min_tokens`` tokens always stay.  A null text
    stays null with no line, an empty one has one empty line.  Rows without an id keep all lines, though they count as one
    document and come first.  Rows equal in id and text get equal results; an id with several texts is one document.  Other
    columns pass through; n_lines and n_dropped replace columns of those names.  Templates are compared by 64-bit hashes.
    With ``exact`` a line of any length, also of digits only or without spaces, has its own tokens as a further template, so the
    later exact copies of every line that is not blank go.
    """
    found = repeated_lines(docs, id_column, text_column, leading, fields, min_tokens, min_general, min_docs, exact)
    text = F.col(text_column)
    docs = docs.drop("n_lines", "n_dropped")
    own, other, digest, dropped = fresh(docs, "_own", "_other", "_digest", "_dropped")
    found = found.select(F.col("_id").alias(other), F.col("_h").alias(digest), F.col("dropped").alias(dropped)).hint("shuffle_hash")
    joined = docs.withColumn(own, F.xxhash64(whole_text(text_column))).join(found, (F.col(id_column) == F.col(other)) & (F.col(own) == F.col(digest)), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(dropped, i)), "\n"))
    return joined.select(*[kept.alias(c) if c == text_column else F.col(c) for c in docs.columns], F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"))


#: DuckDB's form of the result with ``exact`` over ``documents``: doc_id, n_lines, n_dropped, text
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents
), tokens AS (
  SELECT doc_id, no, line, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF t <> ''] AS x,
         [t FOR t IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF t <> ''] AS r FROM lines
), shape AS (
  SELECT *, len(x) AS n, [3 + CAST(floor(greatest(len(x) - 3, 0) * i / 4) AS BIGINT) FOR i IN range(5)] AS e, len([t FOR t IN x IF t <> '<*>']) AS c FROM tokens
), keyed AS (
  SELECT doc_id, no, unnest(list_concat(list_concat(CASE WHEN n > 0 THEN [concat('x ', array_to_string(r, ' '))] ELSE [] END,
    CASE WHEN n >= 5 AND c * 2 >= n THEN [concat('4 ', array_to_string(x, ' '))] ELSE [] END),
    [concat(k, ' ', array_to_string(x[1:e[k + 1]], ' '), ' # ', n, ' # ', array_to_string(x[e[k + 2] + 1:n], ' ')) FOR k IN range(4)
     IF n >= 8 AND (c - len([t FOR t IN x[e[k + 1] + 1:e[k + 2]] IF t <> '<*>'])) * 2 >= n])) AS key FROM shape
), occ AS (SELECT key, doc_id, min(no) AS no FROM keyed GROUP BY ALL
), firsts AS (SELECT key, min(doc_id) AS fd, arg_min(no, doc_id) AS fn FROM occ GROUP BY key HAVING count(*) >= 2
), late AS (SELECT DISTINCT k.doc_id, k.no FROM keyed k JOIN firsts f ON k.key = f.key WHERE k.doc_id > f.fd OR (k.doc_id = f.fd AND k.no > f.fn))
SELECT l.doc_id, count(*) AS n_lines, count(t.no) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (t.no IS NULL), '') AS text
FROM lines l LEFT JOIN late t ON l.doc_id = t.doc_id AND l.no = t.no GROUP BY l.doc_id
"""
