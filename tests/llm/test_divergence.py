"""op11: brute force over fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meshweave.llm import divergence

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
AZ = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    docs = [((text or ""), (lang or ""), (source or "")) for text, lang, source in rows]
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = PATTERN.findall(text.translate(AZ))
        groups[lang].add(source)
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)

        def law(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: law(count[lang, s]) for s in sources}
        everyone = law(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            far = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(gap(p[s][t], everyone[t]), t) for t in kept if count[lang, s][t] and p[s][t] > everyone[t]]
            for part, items, most in (("pair", far, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)}
    return out


ROWS = [
    ("Apple pie, apple PIE and Äpfel", "en", "a"), ("pie pie pie\nEnd", "en", "b"), ("apple\x00end end", "en", "b"), (None, "en", "c"), ("", "en", None),
    ("12345 --- 678", "de", "a"), ("Äpfel äpfel ÄPFEL", "de", "b"), ("Äpfel und 日本語 𝒳x", None, "a"), ("pie apple", "en", "a"), ("pie apple", "en", "a"),
    ("long " * 50_000 + "apple", "en", "d"), ("solo", "xx", "only"), ("İstanbul ISTANBUL ẞ", "tr", "a"), ("istanbul", "tr", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("least, top", [(1, 2), (2, 10), (3, 1), (99, 10)])
def test_equals_brute_force(spark, least, top):
    got = divergence.audit(frame(spark, ROWS), least, top).select("lang", "source", "part", "item", "value", "rank")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(ROWS, least, top)


def test_ties_go_by_bytes(spark):
    rows = [("b a Z é", "en", "s"), ("w w", "en", "t"), ("w w", "en", "u")]
    got = divergence.audit(frame(spark, rows), 1)
    terms = [r["item"] for r in got.where("part = 'term'").orderBy("rank").collect()]
    assert terms == ["a", "b", "z", "é"]
    assert [r["item"] for r in got.where("part = 'pair' and source = 's'").orderBy("rank").collect()] == ["t", "u"]


def test_shares_stay_exact(spark):
    big = 8 * 10**15
    numbers = [F.lit(n) for n in (big // 3, big, 7)]
    assert spark.range(1).select(divergence.share(*numbers)).first()[0] == 1 + 1_000_000_000 * (big // 3 + 2) // (big + 14)


def test_empty_table_and_other_columns(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    plain = frame(spark, ROWS)
    odd = plain.selectExpr("text", "lang", "source", "1 AS term", "'x' AS terms", "2 AS docs", "3 AS `n`")
    assert set(map(tuple, divergence.audit(odd, 2).collect())) == set(map(tuple, divergence.audit(plain, 2).collect()))
    named = plain.selectExpr("text AS `a.b`", "lang AS l", "source AS s")
    assert set(map(tuple, divergence.audit(named, 2, text_col="a.b", lang_col="l", source_col="s").collect())) == set(map(tuple, divergence.audit(plain, 2).collect()))
