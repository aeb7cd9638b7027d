"""Source divergence audit: how far the word use of the sources of a language lies from each other's and from the language's.

Plain relational: matches of a pattern are exploded and counted by (lang, source, term); the terms that
enough documents of a language hold are its vocabulary; every source of the language meets every kept term,
so that terms it lacks count as zeros; a self-join on (lang, term) compares all sources, sums give the
divergence of each pair, and windows rank them. All numbers are whole.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stash

#: A term is a run of ASCII letters and of characters beyond ASCII, [^\x00-\x40\x5B-\x60\x7B-\x7F]+, here for texts
#: without A-Z; the commonest letters come first, so that most characters are settled by one comparison.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
#: Documents of a language that must hold a term for it to be kept; ranks of the terms that are told of each source.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Probabilities are told in parts of STEP ** 3.
STEP = 1000


def terms_of(text: Column) -> Column:
    """All terms of a text in order, only A-Z lower-cased.

    An ASCII text is lowered as a whole; others letter by letter, as lower() would change more of them.
    """
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a source and the documents that hold it.

    Under the term '', which no text holds, docs is the number of all documents of the source, so that
    sources without any terms are told too. A document's distinct terms are found within its row;
    counts are added up before the shuffle, so a source of any size is no group of rows.
    """
    known = lambda name: F.coalesce(column(name).cast("string"), F.lit(""))
    rows = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), terms_of(known(text_col)).alias("terms"))
    held = F.concat(F.array(F.lit("")), F.array_distinct("terms"))
    kinds = F.array(F.struct(F.col("terms").alias("terms"), F.lit(0).alias("doc")), F.struct(held.alias("terms"), F.lit(1).alias("doc")))
    lists = rows.select("lang", "source", F.explode(kinds).alias("kind"))
    words = lists.select("lang", "source", F.col("kind.doc").alias("doc"), F.explode("kind.terms").alias("term"))
    return words.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("doc")).alias("n"), F.sum("doc").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exact for totals up to 9 * 10**15.

    The quotient is below 10**9 and is found three digits at a time, so no product leaves the longs.
    """
    rest, whole, out = count + 2, total + 2 * kept, F.lit(1).cast("long")
    for weight in (STEP * STEP, STEP, 1):
        out = out + F.call_function("div", rest * STEP, whole) * weight
        rest = (rest * STEP) % whole
    return out


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, dense) of term_counts: (lang, source), and (lang, term, source, n, p, q) of every kept term in every source.

    p is the source's share of the term, q the language's. Languages meet their terms in salted parts,
    as one language may have most of all sources and terms; each term then has one row of each source of
    its language, so no (lang, term) is larger than another.
    """
    groups, words = counts.where("term = ''").select("lang", "source"), counts.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stash(kept.drop("docs"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    seen = words.join(kept, ["lang", "term"], "left_semi").select("lang", "term", "source", "n")
    totals = seen.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    heads = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"])

    salts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(heads, ["lang", "salt"])
    dense = met.join(seen, ["lang", "term", "source"], "left").fillna(0, ["n"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    return groups, dense.select("lang", "term", "source", "n", p.alias("p"), q.alias("q"))


def pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways: their gap, summed over all kept terms."""
    # a term that all have alike adds nothing and lets languages without kept terms give pairs too
    none = groups.select("lang", F.lit("").alias("term"), "source", F.lit(1).cast("long").alias("p"))
    rows = dense.select("lang", "term", "source", "p").unionByName(none)
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source"))
    f = gap(F.col("a.p"), F.col("b.p"))
    half = a.join(b, same).select("a.lang", F.col("a.source").alias("one"), F.col("b.source").alias("two"), f.alias("f"))
    half = half.groupBy("lang", "one", "two").agg(F.sum("f").alias("value"))
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    return half.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part 'pair': each other source of the language by its divergence; part 'term': the top_terms terms that
    a source uses more than its language does. Larger values come first, ties by the item's bytes.
    A null text, lang or source counts as the empty string; repeated rows are documents each; texts of
    any length are read whole; columns beside the three are not read; an empty table gives no rows,
    a source alone in its language no pairs, a language without kept terms pairs of value 0.
    """
    counts = stash(term_counts(docs, **columns), "divergence-counts")
    groups, dense = shares(counts, least_docs)
    dense = stash(dense, "divergence-shares")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    far = pairs(groups, dense).withColumns({"part": F.lit("pair"), "rank": rank})
    own = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumns({"part": F.lit("term"), "rank": rank}).where(F.col("rank") <= top_terms)
    return far.select(cols).unionByName(own.select(cols))
