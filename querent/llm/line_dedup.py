"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line descends by its token count and its first ``depth`` tokens, with tokens
that hold a digit generalised to ``<*>``; that path is its leaf.  In a leaf the
line that most documents have becomes the template; lines that agree with it in
at least ``similar`` of their tokens belong to it, and so on with the rest, until
what is left of a leaf is in too few documents to recur.  A round settles the
commonest lines of every leaf at once, in that order.  Leaves that stay large are
settled by keys that similar lines share instead (``settle_large``), in rounds
that grow with the logarithm of their lines.
A template found in ``min_docs`` documents or more recurs: its lines are dropped
from all documents but the first that has it (``keep_first``) or from all.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import discard, materialize, spare

#: A token with a digit; anchored at the token's start, so each is tried once.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def masked(line: Column) -> Column:
    """The line with single spaces and variable tokens generalised.

    Regular expressions run only on lines that need them.
    """
    t = F.trim(line)
    odd = F.contains(t, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(t, F.lit(c))
    flat = F.when(odd, F.trim(F.regexp_replace(t, r"[ \t\r\x0b\x0c]+", " "))).otherwise(t)
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, _VARIABLE, "<*>")).otherwise(flat)


def key_masks(n: int, depth: int, similar: float, exact: int = 500, loose: int = 64) -> tuple[int, list[int]]:
    """Bands of the ``n - depth`` tokens below a leaf, and the sets of bands (as bits) that make keys.

    Similar lines differ in ``d`` tokens at most, hence in ``d`` bands, so they
    agree in one of the sets that leave ``d`` bands out.  Where bands can be
    single tokens (up to ``exact`` sets) lines with a common key are similar;
    else there are as many bands as ``loose`` sets allow, and ``d + 1`` at least.
    """
    rest = max(0, n - depth)
    off = n - ceil(Fraction(repr(similar)) * n)
    if rest <= off:
        return 1, [0]
    bands = rest
    if rest > 62 or comb(rest, off) > exact:
        bands = max((b for b in range(off + 1, min(rest, 62) + 1) if comb(b, off) <= loose), default=off + 1)
    if bands > 62:  # one band of off + 1; -1 - i stands for band i alone, as a long has no bit for it
        return bands, [-1 - i for i in range(bands)]
    return bands, [sum(1 << i for i in chosen) for chosen in combinations(range(bands), bands - off)]


def settle_large(left: DataFrame, depth: int, similar: float, same: str, made: list[DataFrame]) -> DataFrame:
    """(leaf, h, template) of all lines (leaf, h, m, docs) of leaves with many unlike lines.

    Lines get keys of ``key_masks``.  A line that comes first, in its leaf's
    order, in all of its keys has no earlier line like it: it is a template.
    Lines like a template leave with it, and the rest go on.  At the end each
    line goes to the first template like it.  Only lines with a common key are
    compared, and only with templates, so no pairs of a group are made.
    """
    spark = left.sparkSession
    rows = left.withColumn("w", F.split("m", " ")).withColumn("n", F.size(F.split("m", " ")).cast("int")).withColumn("o", F.struct((-F.col("docs")).alias("docs"), F.bitwise_not("h").alias("h")))
    lengths = [r.n for r in rows.select("n").distinct().collect()]
    masks = spark.createDataFrame([(n, *key_masks(n, depth, similar)) for n in lengths], "n int, bands int, masks array<long>")
    bands = f"transform(sequence(0, bands - 1), i -> array_join(slice(w, {depth} + 1 + CAST(i * greatest(0, n - {depth}) div bands AS INT), CAST((i + 1) * greatest(0, n - {depth}) div bands - i * greatest(0, n - {depth}) div bands AS INT)), ' '))"
    own = "filter(b, (x, i) -> IF(mask < 0, -1 - mask = i, shiftright(mask, i) & 1 = 1))"
    banded = rows.join(F.broadcast(masks), "n").withColumn("b", F.expr(bands))
    keys = materialize(banded.select("leaf", "h", "o", "b", F.explode("masks").alias("mask")).select("leaf", "h", "o", F.expr(f"xxhash64(leaf, mask, {own})").alias("key")), "keys")
    texts = materialize(rows.select("leaf", "h", "o", "w"), "key-texts")
    made += [keys, texts]

    def alike(lines: DataFrame, heads: DataFrame) -> DataFrame:
        """(leaf, h, head, o of head) of keyed lines that are like a keyed template before them."""
        x, y = lines.select("leaf", "h", "o", "key"), heads.select("key", F.col("leaf").alias("_leaf"), F.col("h").alias("head"), F.col("o").alias("head_o"))
        met = x.join(y, "key").filter("leaf = _leaf AND head_o < o").groupBy("leaf", "h", "head").agg(F.first("head_o").alias("head_o"))
        met = met.join(texts.select("leaf", "h", F.col("w").alias("x")), ["leaf", "h"]).join(texts.select("leaf", F.col("h").alias("head"), F.col("w").alias("y")), ["leaf", "head"])
        return met.filter(same.replace("x.w", "x").replace("y.w", "y")).select("leaf", "h", "head", "head_o")

    open_keys, templates = keys, None
    while not open_keys.isEmpty():
        first = open_keys.groupBy("key").agg(F.min("o").alias("first"))
        heads = open_keys.join(first, "key").groupBy("leaf", "h").agg(F.bool_and(F.col("o") == F.col("first")).alias("ok")).filter("ok").select("leaf", "h")
        heads = materialize(open_keys.join(heads, ["leaf", "h"], "left_semi"), "key-heads")
        #: A key meets one template at most in a round.
        done = alike(open_keys, heads).select("leaf", "h").union(heads.select("leaf", "h")).distinct()
        open_keys = materialize(open_keys.join(done, ["leaf", "h"], "left_anti"), "key-open")
        made += [heads, open_keys]
        templates = heads if templates is None else templates.union(heads)
    if templates is None:
        return left.select("leaf", "h", F.col("h").alias("template")).limit(0)
    found = alike(keys, templates).groupBy("leaf", "h").agg(F.min_by("head", "head_o").alias("template"))
    return found.union(templates.select("leaf", "h", F.col("h").alias("template")).distinct())


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, min_tokens: int = 3, depth: int = 3, similar: float = 0.7, keep_first: bool = True, most_broadcast: int = 1_000_000, salts: int = 32, most_lines: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without lines of recurring templates.

    All rows and columns stay; ``n_lines_dropped`` is added (it replaces a
    column of that name).  Null texts stay null and blank lines stay, as do
    lines of under ``min_tokens`` tokens, which hold too little to tell a
    template from chance.  Rows that repeat as a whole, and rows of one id,
    count as one document for a template; the first document of a template is
    the one with the smallest id (null last).  Lines are parted by line feeds; a
    text all of whose lines go becomes empty.  An empty table gives an empty one.
    ``salts`` is into how many parts the lines of a template are dealt;
    ``most_broadcast`` leaves at most are sent to all tasks, more are joined by
    a shuffle, with the same result.  Leaves of over ``most_lines`` lines after
    the first round are settled by keys, also with the same result.
    """
    #: Told apart by id and hash, so only texts of one id could be confused.
    row_key = F.xxhash64(F.col(f"`{text_col}`"))
    #: Exploded as masked lines, so that no later filter evaluates the mask again.
    each = docs.select(F.col(f"`{id_col}`").alias("id"), row_key.alias("row"), F.posexplode(F.transform(F.split(F.col(f"`{text_col}`"), "\n"), masked)).alias("pos", "m"))
    each = each.withColumn("n", F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1).filter((F.col("n") >= min_tokens) & (F.col("m") != ""))
    each = each.withColumn("leaf", F.xxhash64("n", F.substring_index("m", " ", depth))).withColumn("h", F.xxhash64("m"))
    keys = materialize(each.select("id", "row", "pos", "leaf", "h"), "lines")

    per_doc = keys.groupBy("leaf", "h", "id").agg(F.lit(1).alias("one"))
    counts = materialize(per_doc.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("docs")), "counts")
    leaves = counts.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("kinds")).filter(F.col("total") >= min_docs)
    leaves = materialize(leaves.select("leaf", "kinds"), "leaves")
    #: Only leaves with different lines need texts: one for each different line.
    mixed = leaves.filter("kinds > 1").select("leaf")
    if mixed.count() <= most_broadcast:
        mixed = F.broadcast(mixed)
    texts = each.select("leaf", "h", "m").join(mixed, "leaf", "left_semi").groupBy("leaf", "h").agg(F.min("m").alias("m"))
    left = materialize(texts.join(counts, ["leaf", "h"]), "texts")

    made = [keys, counts, leaves, left]
    assigned, lines = left.select("leaf", "h", F.col("h").alias("template")).limit(0), 64
    same = "size(filter(zip_with(x.w, y.w, (p, q) -> p = q), z -> z)) >= :s * size(x.w)".replace(":s", repr(similar))
    heads = f"aggregate(array_sort(collect_list(struct(r, h, w))), CAST(array() AS array<struct<r: int, h: bigint, w: array<string>>>), (acc, x) -> IF(exists(acc, y -> {same}), acc, concat(acc, array(x))))"
    first = f"try_element_at(filter(heads, y -> {same.replace('x.w', 'w')}), 1).h"
    while not left.isEmpty():
        order = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("docs"), F.desc("h")))
        top = left.withColumn("r", order).filter(F.col("r") <= lines).withColumn("w", F.split("m", " "))
        tried = left.join(top.groupBy("leaf").agg(F.expr(heads).alias("heads")), "leaf").withColumn("w", F.split("m", " "))
        tried = materialize(tried.select("leaf", "h", "m", "docs", F.expr(first).alias("template")), "tried")
        made.append(tried)
        assigned = assigned.union(tried.filter("template IS NOT NULL").select("leaf", "h", "template"))
        left = tried.filter("template IS NULL").select("leaf", "h", "m", "docs")
        #: Lines in fewer documents than a template needs cannot recur, whatever they share.
        live = materialize(left.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("kinds")).filter(F.col("total") >= min_docs), "live")
        made.append(live)
        if not live.filter(F.col("kinds") > most_lines).isEmpty():
            large = left.join(live.filter(F.col("kinds") > most_lines).select("leaf"), "leaf", "left_semi")
            assigned = assigned.union(settle_large(large, depth, similar, same, made))
            live = live.filter(F.col("kinds") <= most_lines)
        left, lines = left.join(live.select("leaf"), "leaf", "left_semi"), 256
    alone = counts.join(leaves.filter("kinds = 1"), "leaf", "left_semi").select("leaf", "h", F.col("h").alias("template"))
    assigned = materialize(assigned.union(alone), "templates")

    where = materialize(keys.join(assigned, ["leaf", "h"]).select("id", "row", "pos", "leaf", "template"), "where")
    discard(*made, assigned)
    recurring = where.groupBy("leaf", "template", "id").agg(F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first")).filter(F.col("docs") >= min_docs)
    #: A template may have a third of all lines: they are dealt to several tasks.
    salted = where.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(salts)))
    gone = salted.join(recurring.select("leaf", "template", "first", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt")), ["leaf", "template", "salt"])
    if keep_first:
        gone = gone.filter(~F.col("id").eqNullSafe(F.col("first")))
    names = [c for c in docs.columns if c.lower() != "n_lines_dropped"]
    own, of, row, where_id = (spare(x, docs) for x in ("_own", "_drop", "_row", "_id"))
    drop = gone.groupBy(F.col("id").alias(where_id), F.col("row").alias(row)).agg(F.collect_set("pos").alias(of))
    #: What is dropped grows with the corpus, so it is never broadcast, at any size.
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), row_key.alias(own))
    joined = keyed.join(drop.hint("merge"), (keyed[own] == drop[row]) & keyed[f"`{id_col}`"].eqNullSafe(drop[where_id]), "left")
    text = F.expr(f"CASE WHEN `{of}` IS NULL THEN `{text_col}` ELSE array_join(filter(split(`{text_col}`, '\\n'), (l, i) -> NOT array_contains(`{of}`, i)), '\\n') END")
    dropped = F.when(F.col(of).isNull(), 0).otherwise(F.size(of)).cast("long")
    return joined.select(*(text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in names), dropped.alias("n_lines_dropped"))
