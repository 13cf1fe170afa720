import pytest

from winnow.operators.clean import clean, clean_stats
from winnow.operators.cover import hits
from winnow.operators.route import indexed
from winnow.plans import registry
from winnow.plans.compile import compile_rules, stage_summaries
from winnow.sources.staging import staged


def compiled(spark, lines):
    return compile_rules(spark.createDataFrame(list(enumerate(lines)), "ord long, line string"))


def output(spark, lines):
    return [r.line for r in compiled(spark, lines).ordered().collect()]


@pytest.mark.parametrize(
    "lines,want",
    [
        (["||example.org^", "||ads.example.org^", "0.0.0.0 track.example.org"], ["||example.org^"]),
        (["||ads.example.org^", "@@||example.org^"], []),
        (["||example.org^", "@@||*.example.org^"], ["||example.org^"]),
        (["||a.example.org^$client=x", "||a.example.org^$client=y"], ["||a.example.org^$client=x", "||a.example.org^$client=y"]),
        (["||example.org^$important", "||a.example.org^"], ["||example.org^$important", "||a.example.org^"]),
        (["||*.example.org^", "||example.org^"], ["||example.org^"]),
        (["||*.autos^", "||a.b.autos^", "||autos^"], ["||*.autos^", "||autos^"]),
        (["||x.org^$dnstype=A,client=q", "||x.org^$client=q,dnstype=a"], ["||x.org^$dnstype=A,client=q"]),
        (["b.org", "/re[0-9]/", "a.org", "*track*", "/re[0-9]/"], ["||b.org^", "||a.org^", "*track*", "/re[0-9]/"]),
        (["||x.org^$important", "@@||x.org^"], ["||x.org^$important"]),
        (["||x.org^", "@@||x.org^$important"], []),
        (["||x.org^$badfilter", "||y.org^$dnsrewrite=1.1.1.1", "@@/re/", "x.org.", ""], []),
        (["||a.foo.ck^", "||b.a.foo.ck^", "||b.www.ck^", "||www.ck^"], ["||a.foo.ck^", "||www.ck^"]),
        (["||1.2.3.4^", "1.2.3.4", "||3.4^"], ["||1.2.3.4^", "||3.4^"]),
        (["||x.org^$client='a,b'", "||x.org^$client='a\\,b'", '||x.org^$client="a'], ["||x.org^$client='a,b'"]),
    ],
)
def test_output(spark, lines, want):
    assert output(spark, lines) == want


def test_output_does_not_depend_on_partitions(spark):
    lines = [f"||{'a.' * (i % 3)}s{i % 7}.example.org^" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    one, many = (compile_rules(frame.repartition(n)).ordered().collect() for n in (1, 7))
    assert one == many


def test_counters_add_up(spark):
    lines = ["||a.org^", "||a.org^", "0.0.0.0 b.org c.org # x", "localhost", "||bad", "||c.a.org^", "@@||b.org^", "/r/", "||d.org^$client="]
    done = compiled(spark, lines)
    stats = done.stats().first().asDict()
    assert stats["total_input"] == 9 and stats["duplicate_pruned"] == 1 and stats["formats_compressed"] == 2
    assert stats["malformed_discarded"] == 1 and stats["local_hostname_pruned"] == 1 and stats["whitelist_conflict_pruned"] == 1
    assert stats["total_output"] == len(done.ordered().collect()) == 3
    stages = stage_summaries(stats, done.cardinalities().first().asDict())
    assert stages["write"]["emitted"] == 3 and stages["prune"]["reasons"] == {"abp_subdomain": 1, "whitelist_conflict": 1, "local_hostname": 1}


def test_uncertain_keeps_name_the_rule_in_the_way(spark):
    done = compiled(spark, ["||org.example.org^$client=a", "||x.org.example.org^", "||*.autos^$client=z", "||q.autos^", "@@||q.autos^$ctag=t"])
    rows = {r.rule: (r.verdict, r.detail) for r in done.kept.collect()}
    assert rows["||x.org.example.org^"] == ("kept_because_uncertain", "parent_modifier_scope_unproven")
    # The reason is overwritten by the suffix wildcard although the exception came first.
    assert rows["||q.autos^"] == ("kept_because_uncertain", "tld_wildcard_modifier_scope_unproven")


CLEANING = [
    ("", None, "empty", False),
    ("   ", None, "empty", False),
    ("# hello", None, "comment", False),
    ("##.ad", None, "comment", False),
    ("[Adblock Plus 2.0]", None, "cosmetic", False),
    ("example.org##.ad", None, "cosmetic", False),
    ("||a.org^ ## x", None, "cosmetic", False),
    ("||a.org^$script", None, "unsupported_modifier", False),
    ("||a.org/p$script", None, "unsupported_modifier", False),
    ("||a.org/p", None, "url_path", False),
    ("http://a.org", None, "url_path", False),
    ("||a.org^$client=10.0.0.0/8", "||a.org^$client=10.0.0.0/8", None, False),
    ("||^", None, "invalid", False),
    ("@@||", None, "invalid", False),
    ("  ||a.org^  ", "||a.org^", None, True),
    ("||a.org^ # why", "||a.org^", None, True),
    ("||a.org^$client=x # y", "||a.org^$client=x # y", None, False),
    ("/a/b$/", None, "url_path", False),
    ("/ab$c/", "/ab$c/", None, False),
    (" a.org\x1f", "a.org", None, True),
]


def test_cleaning(spark):
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(CLEANING)], "ord long, raw string")
    done = staged(clean(frame), "t")
    got = [(r.raw, r.line, r.discard_reason, r.was_trimmed) for r in done.orderBy("ord").collect()]
    assert got == CLEANING
    stats = clean_stats(done).first()
    assert stats.lines_raw == len(CLEANING) and stats.lines_clean == sum(r[1] is not None for r in CLEANING) and stats.url_path_removed == 3


def test_equal_lines_are_compiled_once_and_counted_each(spark):
    lines = ["||a.org^", "0.0.0.0 b.org c.org", "||c.a.org^$client=x", "/r/", "@@||b.org^", "||bad", "localhost", "", "*t*", "||d.org^$third-party"]
    one, many = compiled(spark, lines), compiled(spark, [*lines, *[f" {x} " for x in lines], *lines[::-1]])
    assert many.found.count() == len(lines) and {r.n for r in many.found.collect()} == {3}
    assert many.output().orderBy("section", "key_o", "o", "line").collect() == one.ordered().collect()
    columns = ("o", "rule", "verdict", "by_o", "by_exception", "detail")
    assert sorted(map(str, many.kept.select(*columns).collect())) == sorted(map(str, one.kept.select(*columns).collect()))
    single, triple = (done.stats().first().asDict() for done in (one, many))
    per_line = {k for k in single if k.startswith("rule_effect_") or k in ("total_input", "malformed_discarded", "local_hostname_pruned")}
    assert triple == single | {k: 3 * single[k] for k in per_line} | {"duplicate_pruned": 2 * 6}
    assert many.routed.count() == 3 * len(lines) and many.rules.where("nth > 1").count() == 2 * 4


def test_nothing_is_compiled_to_nothing(spark):
    done = compiled(spark, [])
    assert set(done.stats().first()) == {0} and done.routed.count() == done.rules.count() == 0


def test_corpus_lines_are_cleaned_and_compiled_once(spark, tmp_path):
    events = spark.range(12).selectExpr("id * 34 * 60 as event_id", "1L as user_id", "'view' as event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    done = registry._compiled(spark, str(tmp_path))
    assert [(r.line, r.ord, r.n) for r in done.found.collect()] == [("||view.u1.shop.co.uk^", 0, 12)]
    stats = done.stats().first()
    assert (stats.total_input, stats.duplicate_pruned, stats.total_output) == (12, 11, 1) and done.lines.count() == 12


def test_repeated_exceptions_are_looked_up_once(spark):
    names = ["q.org", "Q.org", "q.ORG", "Q.ORG"]
    done = compiled(spark, ["||x.q.org^", "||y.q.org^", *[f"@@||{x}^" for x in names], *[f"@@||{x}^$client=a" for x in names]])
    found = hits(indexed(done.rules.where("nth = 1")), done.exceptions)
    assert sorted((r.o.ord, r.t_o.ord) for r in found.collect()) == [(0, 2), (0, 6), (1, 2), (1, 6)]
    assert {(r.rule, r.verdict, r.by_o.ord) for r in done.kept.collect()} == {("||x.q.org^", "exception_covered", 2), ("||y.q.org^", "exception_covered", 2)}
