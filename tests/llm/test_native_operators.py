import collections
import re

import pytest
from helpers import AWKWARD, got, order, table
from pyspark.sql import functions as F

from cohortlens.llm import licences, quality, urls


def judge(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.path), r.action), default=None)
    return host, path, best and best.host + best.path, best.action if best else default, len(fits)


URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1", "https://www.example.org/en/12?q=/es/", "https://example.org/en/2", "http://a.b.c.com/de/#x",
    "http://com/fr/1", "http://notcom/de/", "http://x.com/de", "http://x.com", "no scheme", "", None, "http://", "http://x.org?u=http://y.com/de/",
    "http://" + "a." * 500 + "com/de/" + "p" * 5000, "http://user@x.com:80/de/", "http://x.com:80/fr/", "http://x.com/fr/", "http://x.com/fr/",
]


def test_url_filter_matches_rule_by_rule_search(spark):
    rows = list(enumerate(URLS)) + [(1, URLS[1]), (None, URLS[0])]
    pages = spark.createDataFrame([(i, u, "z", "y") for i, u in rows], "page_id long, url string, host string, digest string")
    df = urls.filter_urls(pages, urls.rules_table(spark, urls.RULES))
    want = [(i, *judge(u, urls.RULES)) for i, u in rows]
    assert got(df, "page_id", "host", "path", "rule", "verdict", "n_rules") == order(want)


def test_url_filter_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert got(urls.filter_urls(pages, none, default="block"), "rule", "verdict") == [(None, "block")]
    assert urls.filter_urls(pages.limit(0), urls.rules_table(spark, urls.RULES)).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(pages, none, default="maybe")


def test_url_filter_tie_prefers_the_longer_path(spark):
    rules = [urls.Rule("allow", "b.org", "/aa"), urls.Rule("block", "org", "/aabb")]
    pages = spark.createDataFrame([(1, "http://b.org/aabb")], "page_id long, url string")
    assert got(urls.filter_urls(pages, urls.rules_table(spark, rules)), "verdict") == [("block",)]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit))


EXTRA = [(20, "a b c a b c x"), (21, "a a a a"), (22, "a a a"), (23, "a b"), (24, "# * $ <b>|x|\n# * $ <b>|x|\n\n \n"), (25, "p q r s t p q r z q r s")]


def test_measurements_match_brute_force(spark):
    rows = AWKWARD + EXTRA
    df = quality.measurements(table(spark, rows))
    want = [(i, *measured(t)) for i, t in rows]
    assert got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words") == order(want)
    assert quality.ledger(table(spark).limit(0)).count() == 0


def test_policies_and_ablations_are_bitwise_views_of_one_ledger(spark):
    marked = quality.ledger(table(spark, AWKWARD + EXTRA)).cache()
    bits = [r["failed_bits"] for r in marked.collect()]
    for policy in quality.POLICIES.values():
        kept = [r["kept"] for r in quality.apply_policy(marked, policy).collect()]
        assert kept == [b & policy.mask == 0 for b in bits]
        for r in quality.ablations(marked, policy).collect():
            bit = quality.BITS[r["rule"]]
            assert r["n_failed"] == sum(b & bit > 0 for b in bits)
            assert r["n_only_this"] == sum(b & policy.mask == bit for b in bits)
    assert {r["n_docs"] for r in quality.ablations(marked.limit(0), quality.POLICIES["v1"]).collect()} == {0}


def test_licence_scan_finds_whole_texts_and_lines_in_equivalent_spellings(spark):
    rows = [
        (1, "RELEASED  under the M.I.T Licence"), (2, "Copyright (c) 2020 A\n(c) 2021 B\n© C\n\nreleased under the mit licence!!"),
        (3, "Some prose.\nThis work is licensed under the GNU General Public Licence, ver 3.\nReleased under the MIT License.\nReleased under the MIT License"),
        (3, "other text"), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (5, "Copyright 2020"), (6, None), (None, "Released under the MIT License")]
    df = licences.scan_licences(table(spark, rows + AWKWARD), licences.known_digests(spark))
    want = [(1, None, "", 0), (2, "MIT", "MIT", 1), (3, None, "GPL-3.0,MIT", 3), (3, None, "", 0), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
            (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (5, None, "", 0), (6, None, "", 0), (None, "MIT", "MIT", 1)]
    assert got(df, "doc_id", "text_licence", "line_licences", "n_licence_lines") == order(want + [(i, None, "", 0) for i, _ in AWKWARD])


def test_licence_tables_of_the_caller(spark):
    known = licences.known_digests(spark, [("Own-1", "Use it well.\nCopyright me"), ("Own-0", "use it WELL"), ("Empty", "")])
    assert known.count() == 1
    df = licences.scan_licences(table(spark, [(1, "Use -- it well"), (2, "")]), known)
    assert got(df, "doc_id", "text_licence") == [(1, "Own-0"), (2, None)]
    assert licences.scan_licences(table(spark).limit(0), known).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark):
    docs = table(spark)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for df in (quality.ledger(docs), licences.scan_licences(docs, licences.known_digests(spark)), urls.filter_urls(pages, urls.rules_table(spark, urls.RULES))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
