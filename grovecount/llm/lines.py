"""Line deduplication by a log-template tree.

Lines are parsed down a tree of fixed depth: the number of tokens, then the
``leading`` first tokens, with tokens that hold a digit generalised to ``<*>``
at once.  In a leaf, a token stays constant if at least ``min_docs`` documents
support it at its position; other positions are variable fields.  The
resulting template recurs if it is found in at least ``min_docs`` documents.
A template may generalise one token in eight (besides digits), or more if its
constant words carry it: they are at least half the tokens, at least two of
them follow the leading ones, at least half of the documents that support the
rarest of those have the whole template, and these are ``2 * min_docs`` or more,
since a template with less of its words fixed needs more evidence.  Common words of
sentences that merely begin alike are supported one by one, but seldom
together, so such sentences do not merge.  Lines of recurring templates are
dropped from every document but the first (smallest id) that has them.

Only hashes travel until a leaf is known to recur: a leaf of fewer than
``min_docs`` documents cannot hold a recurring template.  A line found in a
third of all documents is counted by partial aggregates and is one row from
then on.

Edge cases: null text counts as empty; blank lines, and lines of fewer than
``min_tokens`` tokens, always stay; lines of no more than ``leading`` tokens
have a leaf each and recur by the same document count as longer ones, so lines
of one number each (page numbers) are one template; rows with a null id neither
count nor change; rows that repeat an id count as documents each and get the
same decisions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import bare_words, let

FIELD = "<*>"
FEW = 32  # keys that are scanned one by one


def masked(text: Column) -> Column:
    """Tokens that hold a digit become fields (anchored at token starts)."""
    field = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, field, FIELD)).otherwise(text)


def _masked_lines(text: Column) -> Column:
    """Distinct masked lines of a text."""
    return F.array_distinct(F.split(masked(text), "\n", -1))


def _leaf(tokens: Column, leading: int) -> Column:
    """Path from the root: token count, then the leading tokens."""
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading))


def _lines_in(keys: Column, lines: Column, key_of: Callable[[Column], Column], inside: bool = True) -> Column:
    """Lines whose key is (or is not) among ``keys``: a scan of few keys, a
    binary search of many, so that a document of many lines with many of these
    keys does not take lines x keys steps."""

    def search(among: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            more = (at + width <= F.size(among["keys"])) & (F.get(among["keys"], at + width - 1) <= among["key"])
            return F.when(more, at + width).otherwise(at)

        return let(F.aggregate(among["widths"], F.lit(0), step), lambda at: F.get(among["keys"], at - 1) == among["key"])

    def chosen(table: Column) -> Column:
        def found(key: Column) -> Column:
            many = F.struct(table["keys"].alias("keys"), table["widths"].alias("widths"), key.alias("key"))
            return F.when(F.size(table["keys"]) <= FEW, F.array_contains(table["keys"], key)).otherwise(
                F.coalesce(let(many, search), F.lit(False))
            )

        return F.filter(lines, lambda x: let(key_of(x), found) == F.lit(inside))

    # powers of two down from the number of keys
    widths = F.transform(
        F.sequence(F.floor(F.log2(F.size(keys) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i)
    )
    return let(F.struct(F.sort_array(keys).alias("keys"), widths.alias("widths")), chosen)


def parse(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """``id, row, key, leaf``: each masked line of a document once, as hashes.
    ``row`` numbers the document, for lines that share their leaf with another
    line of the document only."""

    def path(line: Column) -> Column:
        return let(
            bare_words(line),
            lambda w: F.struct(
                F.when(F.size(w) >= min_tokens, _leaf(w, leading)).alias("leaf"), F.xxhash64(line).alias("key"),
            ),
        )

    def shared(lines: Column) -> Column:
        def same(k: Column) -> Column:
            leaf = F.get(lines, k)["leaf"]
            return (leaf == F.get(lines, k - 1)["leaf"]) | (leaf == F.get(lines, k + 1)["leaf"])

        return F.transform(lines, lambda x, k: F.struct(x["key"].alias("key"), x["leaf"].alias("leaf"), same(k).alias("shared")))

    # one array expression, so that each line is split once
    numbered = docs.where("id is not null").select("id", "text", F.monotonically_increasing_id().alias("row"))
    by_leaf = F.sort_array(F.transform(_masked_lines(F.col("text")), path))
    return numbered.select("id", "row", F.explode(let(by_leaf, shared)).alias("x")).select(
        "id", F.when(F.col("x.shared"), F.col("row")).alias("row"), "x.key", "x.leaf"
    ).where("leaf is not null")


def recurring_lines(docs: DataFrame, parsed: DataFrame, min_docs: int, leading: int) -> DataFrame:
    """``key, first_id``: lines (by key) of a recurring template, and the first
    document that has the template."""
    lines = parsed.groupBy("key").agg(
        F.count("*").alias("d"), F.min("id").alias("first_id"), F.first("leaf").alias("leaf")
    )
    # a line whose leaf has too few supporters is out (a document may count here
    # for several lines, so that no leaf is out too early)
    leaves = lines.groupBy("leaf").agg(F.sum("d").alias("leaf_d")).where(F.col("leaf_d") >= min_docs).select("leaf")
    alive = lines.join(leaves.hint("merge"), "leaf").checkpoint()
    # fetch one copy of each line left, from the first document that has it
    wanted = alive.groupBy(F.col("first_id").alias("id")).agg(F.collect_list("key").alias("want"))
    texts = docs.join(wanted.hint("shuffle_hash"), "id").select(
        F.explode(
            _lines_in(F.col("want"), _masked_lines(F.col("text")), lambda x: F.xxhash64(x))
        ).alias("line")
    )
    tokens = texts.groupBy(F.xxhash64("line").alias("key")).agg(F.first("line").alias("line"))
    known = alive.join(tokens.hint("merge"), "key").select(
        "leaf", "key", "d", "first_id", bare_words(F.col("line")).alias("tokens")
    ).checkpoint()
    # below, sums of d count a document once a line: what they count too much
    # comes from documents with several lines in a leaf
    several = parsed.where("row is not null").select("row", "key")
    token_rows = several.join(known.select("leaf", "key", "tokens").hint("merge"), "key").select(
        "row", "leaf", F.posexplode("tokens").alias("i", "token")
    ).groupBy("row", "leaf", "i", "token").agg((F.count("*") - 1).alias("over")).where("over > 0")
    # support of each token at its position in the leaf
    at = known.select("leaf", "key", "d", "first_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"))
    counted = at.select("leaf", "i", "token", "d").unionByName(token_rows.select("leaf", "i", "token", (-F.col("over")).alias("d")))
    support = counted.groupBy("leaf", "i", "token").agg(F.sum("d").alias("support"))
    constant = support.where(F.col("support") >= min_docs)
    general = at.join(constant.hint("merge"), ["leaf", "i", "token"], "left").withColumn(
        "variable", F.col("support").isNull() & (F.col("token") != FIELD)
    ).withColumn("word", F.col("support").isNotNull() & (F.col("token") != FIELD))
    beyond = F.col("word") & (F.col("i") >= leading)
    template = general.groupBy("leaf", "key").agg(
        F.first("d").alias("d"), F.first("first_id").alias("first_id"), F.first("n").alias("n"),
        F.count_if("variable").alias("n_variable"), F.count_if("word").alias("n_words"),
        F.count_if(beyond).alias("n_beyond"), F.min(F.when(beyond, F.col("support"))).alias("rarest"),
        # order-free digest of (position, token or field)
        F.sum(F.xxhash64("i", F.when(F.col("variable"), FIELD).otherwise(F.col("token"))).cast("decimal(20,0)")).alias("t"),
    ).select(
        "leaf", "key", "t", "d", "first_id", "rarest",
        (F.col("n_variable") <= F.floor(F.col("n") / 8)).alias("narrow"),
        # the same for all lines of a template
        ((2 * F.col("n_words") >= F.col("n")) & (F.col("n_beyond") >= 2)).alias("carried"),
    ).where("narrow or carried").checkpoint()
    narrow = F.col("narrow")
    template_rows = several.join(template.select("leaf", "t", "key", "narrow").hint("merge"), "key").groupBy(
        "row", "leaf", "t"
    ).agg((F.count("*") - 1).alias("over"), F.greatest(F.count_if(narrow) - 1, F.lit(0)).alias("narrow_over")).where("over > 0")
    over = template_rows.groupBy("leaf", "t").agg(F.sum("over").alias("over"), F.sum("narrow_over").alias("narrow_over"))
    recurring = template.groupBy("leaf", "t").agg(
        F.sum("d").alias("docs"), F.min("first_id").alias("first"),
        F.sum(F.when(narrow, F.col("d"))).alias("narrow_docs"), F.min(F.when(narrow, F.col("first_id"))).alias("narrow_first"),
        F.first("carried").alias("carried"), F.first("rarest").alias("rarest"),
    ).join(over.hint("merge"), ["leaf", "t"], "left").withColumns({
        "docs": F.col("docs") - F.coalesce("over", F.lit(0)),
        "narrow_docs": F.col("narrow_docs") - F.coalesce("narrow_over", F.lit(0)),
    }).select(
        "leaf", "t", "first", "narrow_first", (F.col("narrow_docs") >= min_docs).alias("narrow_recurs"),
        (F.col("carried") & (F.col("docs") >= 2 * min_docs) & (2 * F.col("docs") >= F.col("rarest"))).alias("recurs"),
    ).where("recurs or narrow_recurs")
    lines_of = template.select("leaf", "t", "key", "narrow").join(recurring.hint("merge"), ["leaf", "t"])
    return lines_of.where("recurs or narrow").select(
        "key", F.when(F.col("recurs"), F.col("first")).otherwise(F.col("narrow_first")).alias("first_id")
    )


def line_drops(docs: DataFrame, parsed: DataFrame, min_docs: int, leading: int) -> DataFrame:
    """``id, drop``: keys of the lines to drop, for documents that have any."""
    recurring = recurring_lines(docs, parsed, min_docs, leading)
    found = parsed.select("id", "key").join(recurring.hint("merge"), "key").where(F.col("id") != F.col("first_id"))
    return found.groupBy("id").agg(F.collect_set("key").alias("drop"))


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 10, leading: int = 2, min_tokens: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc`` (a struct of the row's other columns), ``id, text, kept_text,
    n_lines, n_dropped`` per row."""
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        F.struct(F.lit(True).alias("__row"), *[docs[c] for c in docs.columns if c != text_col]).alias("doc"),
    )
    # both joins below share this exchange of the texts
    dealt = rows.where("id is not null").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    parsed = parse(rows, leading, min_tokens).checkpoint()
    drops = line_drops(dealt, parsed, min_docs, leading)
    out = dealt.join(drops.hint("shuffle_hash"), "id", "left")
    out = out.unionByName(rows.where("id is null"), allowMissingColumns=True).select(
        "doc", "id", "text", F.col("drop").isNotNull().alias("hit"), F.split("text", "\n", -1).alias("lines"), "drop"
    ).withColumn(
        "kept",
        F.when(F.col("hit"), _lines_in(F.col("drop"), F.col("lines"), lambda x: F.xxhash64(masked(x)), False)),
    )
    return out.select(
        "doc", "id", "text",
        F.when(F.col("hit"), F.array_join("kept", "\n")).otherwise(F.col("text")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("hit"), F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
    )


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """``docs`` with its columns, less the lines of recurring templates and less
    the documents of which nothing else was left."""
    out = drop_recurring_lines(docs, id_col=id_col, text_col=text_col, **tree)
    out = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[
        F.col("kept_text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns
    ])


def op5(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
