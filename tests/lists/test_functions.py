import pytest
from pyspark.sql import functions as F

from winnow.functions import modifiers, syntax
from winnow.functions.suffix import with_suffix
from winnow.functions.text import normalize_domain, strip
from winnow.operators.route import classify
from winnow.sources.staging import staged


def parsed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", modifiers.parse(F.col("t")).alias("m"), modifiers.signature(modifiers.parse(F.col("t"))).alias("s"))
    return sorted(rows.collect())


def test_modifier_texts(spark):
    cases = {
        None: [],
        "important": [("important", None, [], False, False)],
        "client=a|~b": [("client", "a|~b", [("a", False), ("b", True)], False, False)],
        "dnstype=a|AAAA": [("dnstype", "a|AAAA", [("A", False), ("AAAA", False)], False, False)],
        "~client=a": [("client", "a", [("a", False)], True, False)],
        "client='x, y|z'": [("client", "'x, y|z'", [("x, y|z", False)], False, False)],
        "client='Frank\\'s'|\"b\"": [("client", "'Frank\\'s'|\"b\"", [("Frank's", False), ("b", False)], False, False)],
        "client=a\\,b": [("client", "a\\,b", [("a,b", False)], False, False)],
        "client": [("client", None, [], False, True)],
        "important=1": [("important", "1", [("1", False)], False, True)],
        "client=": [("client", "", [("", False)], False, True)],
        "client=a||b": [("client", "a||b", [("a", False), ("", False), ("b", False)], False, True)],
        "script": [("script", None, [], False, True)],
        ",": [("", None, [], False, True), ("", None, [], False, True)],
        "client='a": [("client", "'a", [("'a", False)], False, True)],
        "client=a\\": [("client", "a\\", [("a\\", False)], False, True)],
    }
    got = parsed(spark, list(cases))
    for row, want in zip(got, cases.values()):
        assert [(m.name, m.raw_value, [(v.value, v.negated) for v in m["values"]], m.negated, m.uncertain) for m in row.m] == want


def test_signatures_ignore_the_order_of_modifiers_only(spark):
    got = [r.s for r in parsed(spark, ["client=a,dnstype=a", "dnstype=A,client=a", "client=a|b", "client=b|a", "client=a\\|b", "client='a|b'"])]
    assert got[0] == got[1] and got[2] != got[3] and got[4] == got[5] != got[2]


COVERS = [
    (None, None, True),
    (None, "client=a", True),
    ("client=a", None, False),
    ("client=a", "client=a", True),
    ("client=a", "client=a,dnstype=A", True),
    ("client=a", "client=b", False),
    ("client=a|b", "client=b|a", False),
    ("important", None, False),
    (None, "important", False),
    ("important", "important,ctag=x", True),
    ("client=a,client=b", "client=a,client=b", False),
    ("denyallow=a.org", "denyallow=a.org", False),
    ("dnsrewrite=1.1.1.1", None, False),
    (None, "badfilter", False),
    ("script", "script", False),
    ("~client=a", "client=a", False),
    ("client=", "client=", False),
]


def test_scope_covers(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(COVERS)], "i int, p string, c string, want boolean")
    for side in "pc":
        df = df.withColumns({f"{side}_{k}": v for k, v in modifiers.scope_columns(modifiers.parse(F.col(side))).items()})
    got = staged(df.select("i", "want", modifiers.covers(lambda k: F.col(f"p_{k}"), lambda k: F.col(f"c_{k}")).alias("got")), "t")
    assert [r.got for r in got.orderBy("i").collect()] == [c[2] for c in COVERS]


def test_names_cover(spark):
    cases = [([], [], True), (["important"], [], False), (["important"], ["important"], True), ([], ["important"], True), (["dnstype"], [], True), ([], ["dnstype"], False), (["dnstype"], ["dnstype"], False), (["client"], ["client"], False), (["client"], [], True), (["badfilter"], [], False), ([], ["denyallow"], False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c array<string>, p array<string>, want boolean")
    assert [r.got for r in df.select("i", modifiers.names_cover(F.col("c"), F.col("p")).alias("got")).orderBy("i").collect()] == [c[2] for c in cases]


EFFECTS = [
    ("||a.org^", "abp", "block", "apex_and_subdomains", False),
    ("||a.org^$client=x", "abp", "block", "scoped_apex_and_subdomains", True),
    ("||a.org^$important", "abp", "block", "apex_and_subdomains", True),
    ("||a.org^$badfilter", "abp", "disable", "apex_and_subdomains", False),
    ("||a.org^$dnsrewrite=1.1.1.1", "abp", "rewrite", "apex_and_subdomains", False),
    ("||a.org^$foo", "abp", "unsupported", "unsupported_modifier", True),
    ("@@||a.org^", "abp", "exception", "apex_and_subdomains", False),
    ("@@/x/", "regex", "exception", "regex", True),
    ("@@a.org", "other", "exception", "uncertain", True),
    ("/x$y/", "regex", "block", "regex", True),
    ("/a\\/b/$important", "regex", "block", "regex", True),
    ("0.0.0.0 a.org", "hosts", "block", "exact_host", False),
    ("8.8.8.8 a.org", "hosts", "ignored", "none", False),
    ("bad domain.com", "hosts", "ignored", "none", False),
    ("127.0.0.1 localhost", "hosts", "ignored", "none", False),
    ("a.org", "plain_domain", "block", "exact_host", False),
    ("localhost", "plain_domain", "ignored", "none", False),
    ("||^", "invalid", "ignored", "none", False),
    ("||a.org/x^", "abp", "unsupported", "none", True),
    ("*a*", "other", "uncertain", "uncertain", True),
]


def test_effects(spark):
    got = classify(spark.createDataFrame([(i, e[0]) for i, e in enumerate(EFFECTS)], "ord long, line string")).orderBy("ord").collect()
    assert [(r.line, r.kind, r.effect, r.scope, r.uncertain) for r in got] == EFFECTS


def test_rule_split(spark):
    cases = [("||a^$x", "||a^", "x"), ("||a^$", "||a^", None), ("a$b$c", "a$b", "c"), ("/a$b/", "/a$b/", None), ("/a$b/$x", "/a$b/", "x"), ("@@/a/$x", "@@/a/", "x"), ("/a/b$c", "/a/b$c", None), ("/a", "/a", None), ("/a\\/b$c", "/a\\/b", "c")]
    df = spark.createDataFrame(cases, "r string, p string, m string")
    pattern, text = syntax.split_rule(F.col("r"))
    assert [(r.r, r.a, r.b) for r in df.select("r", pattern.alias("a"), text.alias("b")).collect()] == cases


def test_white_space_is_that_of_python(spark):
    cases = [chr(c) for c in (9, 11, 28, 31, 32, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 65)]
    df = spark.createDataFrame([(i, c + "x" + c) for i, c in enumerate(cases)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(strip("s")).collect()] == [(c + "x" + c).strip() for c in cases]
    assert spark.range(1).select(normalize_domain(F.lit(" A.Org.. "))).first()[0] == "a.org"


@pytest.mark.parametrize(
    "domain,tld,registered,parents",
    [
        ("a.b.example.co.uk", "co.uk", "example.co.uk", ["b.example.co.uk", "example.co.uk"]),
        ("x.y.github.io", "io", "github.io", ["y.github.io", "github.io"]),
        ("a.foo.ck", "foo.ck", "a.foo.ck", []),
        ("b.www.ck", "ck", "www.ck", ["www.ck"]),
        ("autos", "autos", None, []),
        ("foo.bar.example", None, None, []),
        ("1.2.3.4", None, None, []),
        ("example.org", "org", "example.org", []),
        ("a.example.xn--p1ai", "xn--p1ai", "example.xn--p1ai", ["example.xn--p1ai"]),
    ],
)
def test_suffixes(spark, domain, tld, registered, parents):
    r = with_suffix(spark.createDataFrame([(domain,)], "domain string")).first()
    assert (r.tld, r.registered, r.parents) == (tld, registered, parents)
