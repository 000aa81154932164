from urllib.parse import urlsplit

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions import urls as U


def test_word_lists_have_their_sizes():
    assert [len(x) for x in (U.KEYWORDS, U.BRANDS, U.COMMON_TLDS, U.ABUSED_TLDS, U.SHORTENERS, U.SCRIPT_ENDINGS, U.ARCHIVE_ENDINGS)] == [36, 38, 20, 26, 18, 7, 9]
    assert len(U.FEATURES) == 52 == len(set(U.FEATURES))


def test_every_url_has_52_finite_features(spark):
    odd = ["https://www.example.com/a", "http://192.168.1.1:8080/x?y=1#z", "bit.ly/abc", "", None, "no url at all", "http://xn--e1afmkfd.com/", "https://u:p@h.com:99999//a//b.php", "http://[bad/x", "http://[::1]:80/q"]
    rows = U.with_features(spark.createDataFrame([(u,) for u in odd], "url string")).select(*U.FEATURES)
    assert all(t == "double" for _, t in rows.dtypes)
    assert all(v is not None and v == v and abs(v) < 1e9 for r in rows.collect() for v in r)
    assert len(rows.collect()) == len(odd)


def test_registrable_domains(spark):
    cases = {"http://news.bbc.co.uk/x": "bbc.co.uk", "https://www.example.com": "example.com", "http://x.github.io": "github.io", "http://192.168.1.1/": "192.168.1.1", "http://a.b.x.ck": "b.x.ck", "http://www.ck": "www.ck", "http://a.b.kobe.jp": "a.b.kobe.jp", "http://city.kobe.jp": "city.kobe.jp", "http://co.uk": "co.uk", "localhost": "localhost"}
    got = U.with_suffix(U.with_parts(spark.createDataFrame([(u,) for u in cases], "url string"))).select("url", "registrable").collect()
    assert {r[0]: r[1] for r in got} == cases


def test_template_boundaries(spark):
    cases = {"https://www.a.com": True, "https://www.a.com/": True, "https://www.a.com/x": False, "http://www.a.com": False, "https://a.com": False, "https://www.a.com?x": False}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", F.col("u").rlike(U.TEMPLATE)).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_parts_agree_with_the_standard_library(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet="abcXYZ019.:/?#@-_=&% \t", max_size=40), min_size=150, max_size=150))
    def run(tails):
        rows = [("http://" + t.rstrip(),) for t in tails]
        for r in U.with_parts(spark.createDataFrame(rows, "url string")).collect():
            p = urlsplit(r["url"])
            assert (r["path"], r["query"], r["fragment"], r["host"]) == (p.path, p.query, p.fragment, p.hostname or "")

    run()


def expected(url):
    try:
        p = urlsplit(url)
    except ValueError:
        return ("", "", "", "", "")
    return (p.netloc, p.path, p.query, p.fragment, (p.hostname or "").lower())


def parted(spark, urls):
    rows = U.with_parts(spark.createDataFrame([(u,) for u in urls], "url string")).select("url", "netloc", "path", "query", "fragment", "host")
    return {r[0]: tuple(r[1:]) for r in rows.collect()}


def test_brackets_hold_addresses_alone(spark):
    names = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "::ffff:1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4", "zz", "v1.a", "v.a", "vF.:x", "fe80::1%eth0", "fe80::1%", "::1%a%b", "12345::", "1::2::3", ":1", "1:", "", "::g"]
    urls = [f"http://{a}[{n}]{b}" for n in names for a, b in (("", "/x"), ("u@", ":80/y?z#w"), ("a", "b"), ("[::1]@", ""))]
    urls += ["http://[/x", "http://]x/y", "http://a]b[c/", "http://[::1", "http://h/[zz]?[q]", "http://[::1]@host/p"]
    got = parted(spark, urls)
    assert {u: got[u] for u in urls if got[u] != expected(u)} == {}


def test_parts_of_characters_of_all_scripts_agree_with_the_standard_library(spark):
    import unicodedata

    rest = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFKC", chr(c)) != chr(c) or c % 97 == 0) and not chr(c).isspace()]
    urls = [f"http://a{c}b.com/p{c}?q={c}" for c in rest]
    got = parted(spark, urls)
    assert {u: got[u] for u in urls if got[u] != expected(u)} == {}
    assert sum(got[u][0] == "" for u in urls) > 10


def test_digits_and_capitals_beyond_ascii(spark):
    text = "①Ⓐ Ⅷ²٣éÉ9Z中"
    r = U.with_features(spark.createDataFrame([(text,), ("http://A1.com",)], "url string")).select("url", "digit_ratio", "upper_ratio").collect()
    for url, digits, upper in r:
        assert (digits, upper) == (sum(map(str.isdigit, url)) / len(url), sum(map(str.isupper, url)) / len(url))
