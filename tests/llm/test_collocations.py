import random
import re
from collections import Counter

import pytest

from chromaloom.llm import collocations, queries
from tests.llm.helpers import SF_DIR, needs_tables, rows, sql


def plain(docs, least, best, percent=100):
    """The contract, word by word, in one place."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for at in range(len(words)):
                for size in range(1, 6):
                    if at + size <= len(words):
                        counts[lang, tuple(words[at : at + size])] += 1
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in frequent.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = lang, words[at : at + size]
                inside[key] = max(inside[key], a)
    found = []
    for (lang, words), a in frequent.items():
        if 100 * inside[lang, words] >= percent * a:
            continue
        n = totals[lang]
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        found.append((lang, -score, -a, " ".join(words).encode(), l, r, n))
    out, ranks = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= best:
            out.append((lang, ranks[lang], phrase.decode(), -a, l, r, n, -score))
    return out


def frame(spark, docs):
    schema = "lang string, text string, phrase string, word string, n string"
    return spark.createDataFrame([(lang, text, "clash", "clash", "clash") for lang, text in docs], schema)


def made(seed, size=60):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Ab", "é", "x\x00y", "ÀB", "zz", *(f"w{k}" for k in range(12))]
    docs = []
    for _ in range(size):
        line = "".join(rng.choices(words, [9, 7, 5, *[2] * (len(words) - 3)])[0] + rng.choice([" "] * 9 + ["\t", ". ", ",", "\n", "  "]) for _ in range(60))
        docs.append((rng.choice(["en", "en", "de", None]), line + " one two three four five six " * rng.randint(0, 2)))
    return docs + [("en", "ab ab ab ab ab ab ab"), ("en", None), ("fr", ""), ("it", "rara avis"), (None, " .,; ")]


def got(spark, docs, least, best):
    found = collocations.collocations(frame(spark, docs).repartition(3), best=best, least=least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_equals_plain_counting(spark):
    docs = made(1)
    assert got(spark, docs, 6, 2000) == sorted(plain(docs, 6, 2000)) != []


@pytest.mark.parametrize(
    "leaves, listed, known, pairs",
    [(40, 10**6, 10**6, 10**6), (8, 10**6, 10**6, 10**6), (8, 10**6, 10**6, 3), (40, 10**6, 5, 10**6), (60, 200, 0, 10**6)],
)
def test_groups_extended_prefixes_and_unknown_words_change_nothing(spark, monkeypatch, leaves, listed, known, pairs):
    """Small groups (prefixes of up to four words extended), long lists, and words beyond the known ones."""
    monkeypatch.setattr(collocations, "GROUP_LEAVES", leaves)
    monkeypatch.setattr(collocations, "LISTED", listed)
    monkeypatch.setattr(collocations, "KNOWN_WORDS", known)
    monkeypatch.setattr(collocations, "KNOWN_PAIRS", pairs)
    for name, value in (("SLICE", 200), ("BLOCK", 64), ("GATHERED", 90), ("FLUSH_WORDS", 10), ("BATCH", 7), ("RANKED", 20)):
        monkeypatch.setattr(collocations, name, value)
    docs = made(2, 30)
    docs += [("en", "the of the of the of the of the of " * 40)]
    if known == 0:
        # The prefixes that are extended have to be known words.
        monkeypatch.setattr(collocations, "GROUP_LEAVES", 10**6)
    assert got(spark, docs, 5, 15) == sorted(plain(docs, 5, 15)) != []


def test_hot_texts_and_a_third_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "GROUP_LEAVES", 64)
    docs = made(3, 20) + [("en", "same words in every copy of this text")] * 300 + [("de", "hot " * 900)]
    assert got(spark, docs, 10, 50) == sorted(plain(docs, 10, 50)) != []


def test_empty_tables_and_texts_without_phrases(spark):
    assert got(spark, [], 2, 10) == got(spark, [(None, None), ("en", ""), ("en", "one. two")], 2, 10) == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(3 * 10**12 + 7, 10**14 + 1, 10**13 + 3, 9 * 10**13 + 1), (10**16 - 1, 10**17 - 1, 10**16 + 1, 10**16 + 3)]
    nodes, totals = [], []
    for k, (a, n, l, r) in enumerate(cases):
        nodes += [(f"l{k}", "x", 1, l, []), (f"l{k}", "y", 1, r, []), (f"l{k}", "x y", 2, a, [l])]
        totals.append((f"l{k}", n))
    made_nodes = spark.createDataFrame(nodes, collocations.NODES)
    scored = collocations._scored(made_nodes, spark.createDataFrame(totals, "lang string, n long")).collect()
    assert {r.lang: r.score for r in scored} == {f"l{k}": 1000 * a * n // (l * r) for k, (a, n, l, r) in enumerate(cases)}


@needs_tables
def test_query_equals_its_sql(spark):
    got = queries.op13_collocations(spark, SF_DIR).toPandas()
    assert len(got) > 0 and rows(got) == rows(sql(queries.SQL["op13_collocations"]).df())
