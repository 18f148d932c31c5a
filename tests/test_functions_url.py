import pytest
from pyspark.sql import functions as F

from corpusloom.functions import url as U

CANONICAL = [
    ("https://h.x", "https://h.x/"),
    ("HTTPS://H.X:443/A/", "https://h.x/A"),
    ("http://h.x:80/", "http://h.x/"),
    ("http://h.x:443/", "http://h.x:443/"),
    ("https://h.x:/a", "https://h.x/a"),
    ("https://h.x//", "https://h.x/"),
    ("https://h.x/a//", "https://h.x/a"),
    ("https://h.x/a//b", "https://h.x/a//b"),
    ("https://u:P@H.x/a", "https://u:P@h.x/a"),
    ("https://h.x/a#frag?x=1", "https://h.x/a"),
    ("https://h.x/a/../b/./c", "https://h.x/b/c"),
    ("https://h.x/../../a", "https://h.x/a"),
    ("https://h.x/a/..", "https://h.x/"),
    ("https://h.x\\a\\b", "https://h.x/a/b"),
    ("https://h.x/für/", "https://h.x/f%C3%BCr"),
    ("https://h.x/f%C3%BCr", "https://h.x/f%C3%BCr"),
    ('https://h.x/a b"<>^`{|}', "https://h.x/a%20b%22%3C%3E%5E%60%7B%7C%7D"),
    ("https://h.x/100%", "https://h.x/100%25"),
    ("https://h.x/%zz", "https://h.x/%25zz"),
    ("https://h.x/😀", "https://h.x/%F0%9F%98%80"),
    ("https://h.x/a?", "https://h.x/a"),
    ("https://h.x?b=2&A=1&a=0&utm_source=z&FBCLID=1", "https://h.x/?a=0&A=1&b=2"),
    ("https://h.x/?flag&q=a+b&r=%zz", "https://h.x/?flag=&q=a%2Bb&r=%25zz"),
    ("https://h.x/?x=2&x=10&x=1", "https://h.x/?x=1&x=10&x=2"),
    ("https://h.x/?a=1=2&&b", "https://h.x/?a=1%3D2&b="),
    ("https://h.x/?UTM_Medium=1&gclid=2&msclkid=3", "https://h.x/"),
    ("https://h.x/?k=%C3%A9&q=*~!'()", "https://h.x/?k=%C3%A9&q=%2A~%21%27%28%29"),
    ("https://h.x/?k=%FF", "https://h.x/?k=%25FF"),
    ("  https://h.x/a \n", "https://h.x/a"),
    ("ftp://h.x/a", "ftp://h.x/a"),
    ("mailto:a@h.x", None),
    ("/a/b", None),
    ("https:///a", None),
    ("", None),
    (None, None),
]


def test_canonicalize_golden(apply):
    assert apply(U.canonicalize, [raw for raw, _ in CANONICAL]) == [want for _, want in CANONICAL]


def test_canonicalize_is_a_fixed_point(apply):
    done = [want for _, want in CANONICAL if want]
    assert apply(U.canonicalize, done) == done


def test_canonicalize_all_keeps_places(apply):
    got = apply(lambda v: U.canonicalize_all(F.array(v, F.lit("x"), v)), ["https://H.x"])
    assert got == [["https://h.x/", None, "https://h.x/"]]


def test_normalize_query(apply):
    assert apply(U.normalize_query, ["?b=1&a=2", "??c", "", "utm_x=1"]) == ["a=2&b=1", "c=", "", ""]


def test_tracking_params(apply):
    keys = ["utm_", "UTM_source", "utm", "fbclid", "GCLID", "msclkid", "msclkid2", "x"]
    assert apply(U.is_tracking_param, keys) == [True, True, False, True, True, True, False, False]


@pytest.mark.parametrize(
    "href, want",
    [
        ("/a", "https://s.com/a"),
        ("b", "https://s.com/d/b"),
        (" b \n", "https://s.com/d/b"),
        ("../c", "https://s.com/c"),
        ("./", "https://s.com/d"),
        ("?q=1", "https://s.com/d/e?q=1"),
        ("//o.com/x", "https://o.com/x"),
        ("http://o.com/x", "http://o.com/x"),
        ("HTTP://O.com", "http://o.com/"),
        ("#t", None),
        ("MAILTO:x@y", None),
        ("tel:1", None),
        ("javascript:void(0)", None),
        ("\\a", "https://s.com/a"),
        ("c:d", None),
    ],
)
def test_resolve(apply, href, want):
    base = F.lit("https://s.com/d/e?k=1")
    assert apply(lambda v: U.canonicalize(U.resolve(base, v)), [href]) == [want]


def test_resolve_on_a_root_without_path(apply):
    assert apply(lambda v: U.canonicalize(U.resolve(F.lit("https://s.com"), v)), ["a", "?x"]) == [
        "https://s.com/a",
        "https://s.com/?x=",
    ]


def test_names(apply):
    urls = ["https://h.x/", "https://h.x/About-Us/Team?b=2", "https://h.x/___", "https://h.x/a.html", "https://h.x/?q=1", "https://h.x/f%C3%BCr"]
    assert apply(U.slug, urls) == ["home", "about-us_team_b_2", "home", "a_html", "q_1", "f_c3_bcr"]
    assert apply(U.fallback_title, urls) == ["", "About Us/Team", "___", "a.html", "", "f%C3%BCr"]
    names = apply(U.stable_filename, urls)
    assert names[0].startswith("home_") and names[0].endswith(".md") and len(names[0]) == len("home_") + 8 + 3
    assert len(set(names)) == len(names)


def test_parts(apply):
    urls = ["https://u@H.x:8443/a?b", "http://h.x/", "nothing"]
    assert apply(U.host, urls) == ["h.x", "h.x", ""]
    assert apply(U.authority_prefix, urls) == ["https://u@H.x:8443", "http://h.x", ""]
    assert apply(U.is_http, ["HTTP://a", "https://a", "ftp://a", "file:///a"]) == [True, True, False, False]
    assert apply(lambda v: U.same_host(v, F.lit("https://H.X/"), F.lit(True)), ["http://h.x/a", "https://www.h.x/"]) == [True, False]
    assert apply(lambda v: U.same_host(v, F.lit("https://h.x/"), F.lit(False)), ["https://other/"]) == [True]
