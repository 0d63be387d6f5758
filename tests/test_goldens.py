"""Small cases with known answers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pagefacts.functions import text as T
from pagefacts.functions import urls as U
from pagefacts.operators import gates as G
from pagefacts.operators import hits as H
from pagefacts.operators import page_jobs as P
from pagefacts.operators import records as R
from pagefacts.operators import run_stats as S
from pagefacts.plans import pages as page_plans
from pagefacts.sources import export, runlog
from pagefacts.streaming import jobs as J

NOW = "2026-09-24 09:50:00"


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def runs(spark, rows):
    schema = "id long, ts timestamp_ntz, elapsed_ms long, outcome string, kind string, preset string, source string, records long, pages long, judge_cost_usd double, llm_cost_usd double, planner_cost_usd double, query string"
    return spark.createDataFrame([(i, ts, ms, o, k, p, "ui", 1, 1, c, None, None, "q") for i, (ts, ms, o, k, p, c) in enumerate(rows)], schema)


def test_days_are_clamped():
    assert [S.clamp_days(d) for d in (0, -4, 9999)] == [1, 1, 365]
    assert S.clamp_days(30, "hour") == 7


@pytest.mark.parametrize(("bucket", "days", "n", "first"), [("day", 30, 30, "2026-08-26"), ("hour", 1, 24, "2026-09-23T10"), ("week", 7, 2, "2026-09-14"), ("week", 30, 5, "2026-08-24")])
def test_empty_series(spark, bucket, days, n, first):
    out = S.activity_series(runs(spark, []), bucket, days, NOW).orderBy("bucket").collect()
    assert len(out) == n and out[0].bucket.startswith(first) and {r.runs for r in out} == {0} and {r.cost for r in out} == {0.0}


def test_totals_leave_out_old_and_future_runs(spark):
    day = dt.datetime(2026, 9, 24, 9)
    rows = [(day, 1000, "complete", "answer", "quick", 0.1), (day, 2000, "empty", "answer", "quick", 0.002), (day, 3000, "failed", "harvest", "standard", 0.01), (day - dt.timedelta(40), 1, "complete", "answer", "quick", 1.0), (day + dt.timedelta(1), 1, "complete", "answer", "quick", 1.0)]
    every = runs(spark, rows)
    total = S.run_totals(S.in_range(every, "day", 30, NOW)).first()
    assert (total.runs, total.cost, total.success_rate) == (3, 0.112, 0.3333)
    all_time = S.all_time(every).first()
    assert (all_time.runs, all_time.cost) == (5, 2.112)
    assert [r.id for r in S.recent_runs(every, 3).collect()] == [4, 2, 1]
    assert {r.preset: r.runs for r in S.by_value(every, "preset", S.PRESETS).collect()} == {"quick": 4, "standard": 1, "thorough": 0}
    empty = S.run_totals(every.limit(0)).first()
    assert (empty.runs, empty.avg_cost, empty.success_rate) == (0, 0.0, 0.0)


@pytest.mark.parametrize(("values", "p50", "p90"), [(range(1, 11), 5, 9), ([7], 7, 7), ([1, 2, 3], 2, 3), ([], 0, 0)])
def test_nearest_rank(spark, values, p50, p90):
    df = spark.createDataFrame([(v * 1000,) for v in values], "elapsed_ms long")
    r = S.latency_percentiles(df).first()
    assert (r.p50, r.p90) == (p50, p90)


def test_unreported_prices(spark):
    schema = "id int, judge_requests int, judge_cost_usd double, llm_requests int, llm_cost_usd double, planner_requests int, planner_cost_usd double"
    df = spark.createDataFrame([(1, 1, 0.5, 2, None, 0, None), (2, 1, 0.5, 0, None, 0, None)], schema)
    assert {r.id: r.cost for r in S.strict_run_cost(df).collect()} == {1: None, 2: 0.5}
    assert S.cost_by_actor(df).first().total == 1.0


def test_clamped_mean(spark):
    rows = [("a", i, i, 3.7) for i in range(60)] + [("b", 0, 0, 2.0), ("b", 1, 1, 3.0), ("c", 0, 0, 0.1)]
    df = spark.createDataFrame(rows, "k string, ts int, id int, x double")
    assert {r.k: r.ema for r in S.clamped_ema(df, "k").collect()} == {"a": 3.5, "b": 2.3, "c": 2.0}


def test_canonical_and_display_urls(spark):
    urls = ["https://www.Example.org/a/?utm_source=x&b=2&a=1#f", "http://example.org/a?a=1&b=2", "not a url ", "https://x.org/p?lang=es&code=ES", "https://x.org/p?error=1&code=abc", "https://x.org/?code=b980f9c2-aaaa-4444-bbbb"]
    key = each(spark, U.canonical_url, urls)
    assert key[0] == key[1] == "example.org/a?a=1&b=2" and key[2] == "not a url" and key[3] == "x.org/p?code=ES"
    shown = each(spark, U.display_url, urls)
    assert shown[0] == "https://www.Example.org/a/?b=2&a=1#f" and shown[2:] == ["not a url", "https://x.org/p?lang=es&code=ES", "https://x.org/p", "https://x.org/"]
    assert each(spark, U.site_stem, ["https://www2.icab.cat/x", "https://icab.es", "https://news.bbc.co.uk/1", "bad"]) == ["icab", "icab", "bbc", ""]
    assert each(spark, U.unwrap_redirect, ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx&rut=1", "https://duckduckgo.com/y", "https://a.org", ""]) == ["https://a.org/x", "", "https://a.org", ""]


def test_resolved_links(spark):
    df = spark.createDataFrame([("https://a.org/x/y?q=1", h) for h in ("z", "../z", "/z", "?p=2", "//b.org/c", "https://c.org/d#f", "./a/../b")], "base string, href string")
    assert [r.out for r in df.select(U.resolve(F.col("base"), F.col("href")).alias("out")).collect()] == ["https://a.org/x/z", "https://a.org/z", "https://a.org/z", "https://a.org/x/y?p=2", "https://b.org/c", "https://c.org/d", "https://a.org/x/b"]


def test_title_keys(spark):
    out = each(spark, T.title_key, ["Decidim launches new release — Reuters", "Decidim launches new release | El País", "Decidim launches new release: BBC", "Guide: one two three four five six words", "Short"])
    assert out[0] == out[1] == out[2] == "decidim launches new release" and out[3] == "guide one two three four five six words" and out[4] == "short"


def test_page_text(spark):
    word = '<script type="application/ld+json">{"articleBody": "%s"}</script>' % ("word " * 5_000)
    pages = {
        '<p>Hi</p><script>var x="<p>no</p>"</script><style>b{}</style>Bye': "\nHi\nBye\n",
        "a<header>b</header><script>keep the rest": "a\nb\nkeep the rest\n",
        "x &amp;eacute; &eacute; &#233; &#x20AC; &amp;#65; &#bad;&#xD800;&#0;.": "x &eacute; é é € A \0.\n",
        '<script type="application/ld+json">{"url": "https:\\/\\/a"}</script><img src=x alt="Logo">': '{"url": "https://a"}\nLogo\n',
        "<img alt='One two'/><IMG ALT=three src=x>end<img alt=\"\"><img src=y><image alt=no>": "One two three end\n",
        '<img alt="a<b">c': "a<b c\n",
        "<p>one</p>\n\n\n<p>two</p>  \n\t\n <p>three": "\none\n\ntwo\n\nthree\n",
        "a  b\t c \n d": "a  b\t c\nd\n",
        "\n\n \nx\n\n\n": "\nx\n\n",
        "": "", " ": "\n", "x < y > z": "x  z\n", "a<!-- <b>c --> d": "ac --> d\n", "cut<p class='x": "cut\n",
        "<svg/>in<svg><p>no</p></svg>out<script src=a>b</script >": "outb\n",
    }
    out = dict(zip(pages, each(spark, T.page_text, list(pages)), strict=True))
    for html, want in pages.items():
        assert out[html] == want, html
    # Each block of structured data is cut for itself.
    long = each(spark, T.page_text, [f"<p>x</p>{word}{word}<p>y"])[0].split("\n")
    assert long[1] == "x" and long[4:] == ["y", ""] and long[2] == long[3] and 1995 <= len(long[2]) <= 2000
    assert each(spark, T.page_text, [None]) == [None]


def test_page_text_of_whole_pages(spark):
    pages = [
        "<html><head><title>Café » Paris</title></head><body><p>Le café coûte 3€ — vraiment.</p><script>var x = 1;</script><div>日本語のテキスト</div></body></html>",
        "<html>\n<head>\n<title>About Sid</title>\n<style>:root{--wp--preset--color:#000}</style>\n</head>\n<body>\n<p>Sid Sijbrandij co-founded GitLab.</p>\n<script>window.__DATA__ = {\"x\": 1};</script>\n<noscript>enable js</noscript>\n<svg><path d=\"M0 0L10 10\"/></svg>\n<p>He served as CEO from 2012 to 2024.</p>\n</body></html>",
        '<html>\n<head>\n<script>var tracker = 1;</script>\n<script type="application/ld+json">\n{"@type": "Organization",\n"name": "MONDRAGON CORPORATION",\n"url": "https:\\/\\/www.mondragon-corporation.com\\/en\\/"}\n</script>\n</head>\n<body>\n<p>Humanity at work.</p>\n</body></html>',
        "<html><head><title>t</title></head>\n<body>\n<header>Site navigation</header>\n<p>The article itself.</p></body></html>",
        '<p>Before.</p>\n<script src="a.js">\n<p>After the broken script.</p>',
        "<p>Ingenieros T&eacute;cnicos, Agr&ograve;noms, &Ntilde;u&ntilde;ez, &Ccedil;AT</p>",
        "<p>&amp;eacute; and &amp;amp;</p>",
        "<p>a&nbsp;&amp;&nbsp;b &#8212; &#x27;q&#x27; &hellip;</p>",
    ]
    assert each(spark, T.page_text, pages) == [
        "\nCafé » Paris\nLe café coûte 3€ — vraiment.\n日本語のテキスト\n",
        "\nAbout Sid\n\nSid Sijbrandij co-founded GitLab.\n\nHe served as CEO from 2012 to 2024.\n\n",
        '\n{"@type": "Organization", "name": "MONDRAGON CORPORATION", "url": "https://www.mondragon-corporation.com/en/"}\n\nHumanity at work.\n\n',
        "\nt\n\nSite navigation\n\nThe article itself.\n",
        "\nBefore.\n\nAfter the broken script.\n",
        "\nIngenieros Técnicos, Agrònoms, Ñuñez, ÇAT\n",
        "\n&eacute; and &amp;\n",
        "\na & b — 'q' …\n",
    ]


def test_paragraphs_of_page_text_are_chunk_borders(spark):
    html = "".join(f"<p>{chr(97 + i) * 300}</p>\n\n" for i in range(12))
    out = each(spark, lambda c: T.chunks(T.page_text(c), 400), [html])[0]
    assert out == [chr(97 + i) * 300 for i in range(12)]


def test_contacts(spark):
    assert each(spark, T.emails, ["Mail info (at) town (dot) org or INFO@town.org. email@x.com a@example.com", "available at www.x.es, meet at the office", "info at ayto-x . es"]) == [["info@town.org"], [], ["info@ayto-x.es"]]
    assert each(spark, T.urls, ["see https://a.org\\/b, www.c.org/d."]) == [["https://a.org/b", "https://www.c.org/d"]]
    assert each(spark, T.phones, ["call +34 600 12.34.56, not 1.2.3.4-5"]) == [["+34 600 12.34.56"]]


def test_entity_keys(spark):
    names = ["Ayuntamiento de Madrid", "MADRID", "Ajuntament d'Olot", "Bilboko Udala (Ayuntamiento de Bilbao)", "Alcalá (Madrid)", "BILBAO UDALA", "bottelet/DayByDayCRM", "a/b/c", "Ayto. de  Straße-Œuvre"]
    assert each(spark, T.normalize_entity, names) == ["madrid", "madrid", "olot", "bilbao", "alcala", "bilbao", "daybydaycrm", "a b c", "strasse oeuvre"]


def test_chunks(spark):
    out = each(spark, lambda c: T.chunks(c, 400), ["\n\n".join(["x" * 300] * 3), "Home\n\nAbout", "word " * 20_000, None])
    assert len(out[0]) >= 2 and out[1] == [] and len(out[2]) == 40 and max(map(len, out[2])) <= 400 and out[3] is None


def test_borders_of_chunks(spark):
    line = lambda c, n: c * n
    texts = [
        line("a", 150) + "\n" + line("b", 100) + " " + line("c", 100),  # before the line end; what is left begins with one, so its spaces do not count
        line("a", 50) + "\n" + line("b", 120) + " " + line("c", 150),  # a line end in the first half: hard, though a space is late
        line("a", 150) + " " + line("b", 100) + " " + line("c", 100),  # before the last space
        line("a", 90) + " " + line("b", 300),  # a space in the first half: hard
        line("x", 100) + "\n\n" + line("y", 100) + "\n\n" + line("z", 100),  # packs of 200 characters, the joint not counted
        line("x", 100) + "\n \n" + line("y", 99),  # a line of blanks parts nothing; cut before its second line end
        line("x", 90) + "\n\n" + "y" * 80,  # fits with the first
        line("x", 150) + "\n\n" + "y" * 80,  # 80 characters are no chunk
        "é😀" * 150,
    ]
    out = each(spark, lambda c: T.chunks(c, 200, None), texts)
    assert out == [
        ["a" * 150, "b" * 100 + " " + "c" * 98],
        ["a" * 50 + "\n" + "b" * 120 + " " + "c" * 28, "c" * 122],
        ["a" * 150, "b" * 100 + "\n\n" + "c" * 100],
        ["a" * 90 + " " + "b" * 109, "b" * 191],
        ["x" * 100 + "\n\n" + "y" * 100, "z" * 100],
        ["x" * 100 + "\n\n" + "y" * 99],
        ["x" * 90 + "\n\n" + "y" * 80],
        ["x" * 150],
        ["é😀" * 100, "é😀" * 50],
    ]


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query int, lane string, lane_ord int, pos int, url string, title string, snippet string")


def test_syndicated_copies(spark):
    title = "A long wire story headline"
    rows = [("a", 0, 1, "https://www.icab.cat/1", title, ""), ("a", 0, 2, "https://icab.es/2", title, ""), ("a", 0, 3, "https://www2.icab.cat/3", title, ""), ("b", 1, 1, "https://other.org/x", title, ""), ("b", 1, 2, "https://o1.org", "NEOTEC 2024", ""), ("b", 1, 3, "https://o2.org", "NEOTEC 2024", "")]
    assert {r.url for r in H.merge_hits(hits(spark, rows)).collect()} == {u for _, _, _, u, _, _ in rows} - {"https://other.org/x"}


def test_merged_hit(spark):
    rows = [("a", 0, 3, "https://www.x.org/p?utm_source=1", "", "longer snippet"), ("b", 1, 1, "http://x.org/p", "Title", "short"), ("b", 1, 2, "https://y.org", "One two three four", ""), ("b", 1, 4, "https://y.org/", "Five six seven eight", "")]
    out = {r.key: r for r in H.merge_hits(hits(spark, rows)).collect()}
    assert (out["x.org/p"].pos, out["x.org/p"].title, out["x.org/p"].snippet, out["x.org/p"].engines) == (1, "Title", "longer snippet", ["a", "b"])
    assert len(out) == 2


def test_dedupe_hits(spark):
    df = spark.createDataFrame([(1, 1, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx"), (1, 2, "https://www.a.org/x"), (1, 3, "https://a.org/x?utm_medium=2")], "query int, rank int, url string")
    assert H.dedupe_hits(df).count() == 1


def test_cache(spark):
    day = dt.datetime(2026, 1, 1)
    puts = spark.createDataFrame([(1, "a", "New  York", 5, day, 3), (2, "a", "new york", 5, day + dt.timedelta(hours=1), 2), (3, "b", "x", 5, day, 0)], "put_id int, lane string, query string, max_hits int, stored_at timestamp_ntz, hits int")
    cache = H.latest_cache_entry(puts)
    assert [(r.put_id, r.hits) for r in cache.collect()] == [(2, 2)]
    asked = spark.createDataFrame([(1, "a", " NEW york ", 5), (2, "b", "new york", 5), (3, "a", "new york", 6)], "id int, lane string, query string, max_hits int")
    look = lambda now: {r.id: r.hit for r in H.cache_lookup(asked, cache, now).collect()}
    assert look("2026-01-01 06:00:00") == {1: True, 2: False, 3: False} and look("2026-01-01 07:00:01")[1] is False


def test_merged_records(spark):
    rows = [("g", 1, "A", None, 0.2, "related", "unchecked", "u1"), ("g", 2, "B", "T", 0.9, "unresolved", "contradicts", "u2"), ("g", 3, "", "U", 0.95, "same", "mixed", "u1")]
    rows = [(*x[:6], [x[6]], x[7]) for x in rows]
    schema = "name string, record_id int, brand string, type string, grounding double, binding string, statuses array<string>, source_url string"
    r = R.merge_records(spark.createDataFrame(rows, schema), "name", ["brand", "type"]).first()
    assert (r.brand, r.type, r.binding, r.statuses, r.sources, r.provenance) == ("B", "U", "same", ["contradicts"], "u1|u2", {"brand": ("u2", 0.9), "type": ("u1", 0.95)})


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(["not_addressed", "mixed"], ["supports", "ambiguous"], ["supports", "mixed"]), (["unchecked"], ["mixed"], ["mixed"]), ([], ["supports"], ["supports"]), (["ambiguous"], [], ["ambiguous"]), (["mixed"], ["not_addressed", "unchecked"], ["mixed", "unchecked"])],
)
def test_merged_statuses(spark, a, b, want):
    df = spark.createDataFrame([("g", i, "x", 0.5, "same", s, "u") for i, s in enumerate((a, b))], "name string, record_id int, brand string, grounding double, binding string, statuses array<string>, source_url string")
    assert R.merge_records(df, "name", ["brand"]).first().statuses == want


def test_provenance_through_merges(spark):
    """A field's own source counts, not its record's page; what was merged merges again."""
    schema = "name string, record_id int, brand string, type string, grounding double, binding string, statuses array<string>, source_url string, provenance map<string,struct<source_url:string,grounding:double>>"
    rows = [("g", 1, "A", "T", 0.9, "same", [], "u1", {"brand": ("v1", 0.3)}), ("g", 2, "B", "U", 0.5, "same", [], "u2", None), ("g", 3, "C", "", 0.1, "same", [], "u3", {"brand": ("v3", 0.2), "type": ("v3", 0.99)}), ("h", 4, None, "", 0.9, "same", [], "u4", {})]
    out = {r.name: (r.brand, r.type, r.provenance) for r in R.merge_records(spark.createDataFrame(rows, schema), "name", ["brand", "type"]).collect()}
    assert out == {"g": ("B", "T", {"brand": ("u2", 0.5), "type": ("u1", 0.9)}), "h": (None, None, {})}
    first = R.merge_records(spark.createDataFrame(rows[:2], schema), "name", ["brand", "type"]).withColumns({"record_id": F.lit(1), "grounding": F.lit(0.05), "source_url": F.lit("merged")})
    again = first.select("name", "record_id", "brand", "type", "grounding", "binding", "statuses", "source_url", "provenance").union(spark.createDataFrame(rows[2:], schema))
    assert {r.name: (r.brand, r.type, r.provenance) for r in R.merge_records(again, "name", ["brand", "type"]).collect()} == out
    told = [({"b": "1"}, {"b": ("other", 0.5)}, "u", 0.5, 1.0)]
    csv = export.csv_table(spark.createDataFrame(told, "fields map<string,string>, provenance map<string,struct<source_url:string,grounding:double>>, source_url string, grounding double, constraint_support double"), ["b"])
    assert [tuple(r) for r in csv.collect()] == [("1", "u", "0.50", "1.00", "other")]


def test_row_limits():
    assert [R.row_limit(), R.row_limit(0), R.row_limit(7, 3), R.row_limit(None, 3), R.row_limit(None, 0)] == [50, None, 7, 3, 1]


def test_authorities(spark):
    pages = spark.createDataFrame([(1, True, 3, 0.8, 9), (2, True, 2, 0.9, 1), (3, False, 9, 1.0, 2), (4, True, 5, None, 3), (5, True, 5, 0.9, 4)], "page int, on_anchor boolean, entities int, completeness double, seq int")
    found = G.enumeration_authorities(pages)
    assert [r.page for r in found.orderBy("seq").collect()] == [5, 1]
    records = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False), ("e", False)], "record string, own_site boolean")
    presence = spark.createDataFrame([("a", 1, 0.1), ("a", 5, 0.2), ("b", 1, 0.1), ("c", 1, 0.0), ("c", 5, 0.0), ("d", 1, 0.0), ("d", 5, 0.3), ("e", 1, None), ("e", 5, 0.0), ("a", 3, 1.0)], "record string, page int, presence double")
    assert {r.record for r in G.drop_unmentioned(records, presence, found).collect()} == {"b", "c", "d", "e"}
    assert G.drop_unmentioned(records, presence, pages.where("page = 0")).count() == 5


def test_anchors(spark):
    df = spark.createDataFrame([("partners list", "Decidim.org"), ("DECIDIM partners", "www.decidim.org"), ("plans", "Linear Inc.")], "q string, a string")
    assert [r.x for r in df.select(H.ensure_anchor(F.col("q"), F.col("a")).alias("x")).collect()] == ["partners list Decidim", "DECIDIM partners", "plans Linear Inc."]


def test_components_are_stable(spark):
    pairs = [(i, i + 1, "name", 2.0) for i in range(1, 20)] + [(50, 60, "name", 1.0), (70, 80, "email", 1.0)]
    out = {r.node: r.component for r in R.merge_groups(spark.createDataFrame(pairs, "a long, b long, kind string, score double")).collect()}
    assert out == dict.fromkeys(range(1, 21), 1) | {70: 70, 80: 70}


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, None, 0.9, "contradicts"), (1, 2, 0.9, 0.9, "supports"), (2, 1, 0.3, 0.7, "mixed"), (2, 2, 0.1, 0.9, "what")], "record int, constraint int, p double, page_p double, label string")
    out = {r.record: (r.excluded, r.support, r.statuses) for r in G.gate_constraints(df).collect()}
    assert out == {1: (True, 0.0, "contradicts,supports"), 2: (False, 0.1, "supports,not_addressed")}
    bad = spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, 0.5), (4, None)], "i int, p double")
    assert {r.i for r in G.validate_scores(bad, ["p"]).collect()} == {3, 4}
    safe, held = G.gate_quarantine(spark.createDataFrame([(1, None), (2, 0.55), (3, 0.5)], "i int, injection double"))
    assert {r.i for r in safe.collect()} == {3} and {r.i for r in held.collect()} == {1, 2}


def test_csv_columns(spark):
    rows = [({"b": "1", "z": "2"}, {"b": "u", "z": "other"}, "u", 0.5, 1.0), ({"a": "3"}, {"a": "u"}, "u", 0.25, 1.0)]
    out = export.csv_table(spark.createDataFrame(rows, "fields map<string,string>, provenance map<string,string>, source_url string, grounding double, constraint_support double"), ["b"])
    assert out.columns == ["b", "a", "z", "source_url", "grounding", "constraint_support", "z_source_url"]
    assert [tuple(r) for r in out.orderBy("b").collect()] == [("", "3", "", "u", "0.25", "1.00", ""), ("1", "", "2", "u", "0.50", "1.00", "other")]


def test_run_log_lines(spark):
    lines = spark.createDataFrame([('{"id":"a","records":3,"new":1}',), ("",), ('{"id":"b","records":"x"}',), ("{broken",), ('{"id":"c","llm_cost_usd":0.5}',)], "value string")
    good, bad = runlog.parse_run_log(lines)
    assert {(r.id, r.records, r.llm_cost_usd, r.kind) for r in good.collect()} == {("a", 3, None, ""), ("c", 0, 0.5, "")} and bad.count() == 2


def test_decoded_pages(spark):
    rows = [
        ("a", "é".encode("latin-1"), "iso-8859-1"), ("b", b'<meta charset="windows-1252">\x80', None), ("c", "é".encode(), None), ("d", b"\xff\x80", None), ("e", b"\x80\x81", "ISO-8859-1"),
        ("f", b"a\xff", "utf-8"), ("g", "日本".encode("shift_jis"), "Shift_JIS"), ("h", b'<meta charset=koi8-r>\xc1', "no-such-label"), ("i", b'<?xml charset="KOI8-R"?>\xc1', None), ("j", b"", None), ("k", None, None),
    ]
    out = {r.url: r.html for r in export.decode_pages(spark.createDataFrame(rows, "url string, content binary, charset string")).collect()}
    assert out["a"] == "é" and out["b"].endswith("€") and out["c"] == "é" and out["d"] == "ÿ€" and out["e"] == "€\x81"
    assert out["f"] == "a\ufffd" and out["g"] == "日本" and out["h"].endswith("Á") and out["i"].endswith("а") and out["j"] == out["k"] == ""


def test_page_files(spark, sf, tmp_path):
    """Raw files in four encodings, declared by a header, in the page, or not at all; and the pages of the table."""
    text = "<p>Ébène ñandú €</p>"
    (tmp_path / "in/sub").mkdir(parents=True)
    files = {"a.html": text.encode("iso-8859-15"), "sub/b.html": b'<meta charset="windows-1252">' + text.encode("windows-1252"), "c.html": text.encode(), "d.html": text.encode("utf-16-le")}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    headers = spark.createDataFrame([(f"file:{tmp_path}/in/a.html", 'text/html; Charset="ISO-8859-15"'), (f"file:{tmp_path}/in/d.html", "text/html;charset=utf-16"), (f"file:{tmp_path}/in/c.html", "text/html")], "url string, content_type string")
    out = {r.url.split("/in/")[1]: r.html for r in export.read_page_files(spark, f"{tmp_path}/in", headers).collect()}
    assert out == {"a.html": text, "sub/b.html": '<meta charset="windows-1252">' + text, "c.html": text, "d.html": text}
    (tmp_path / "pages").mkdir()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for i, html in pages.items():
        (tmp_path / f"pages/{i}.html").write_bytes(html.encode())
    assert {int(r.url.rsplit("/", 1)[1][:-5]): r.html for r in export.read_page_files(spark, f"{tmp_path}/pages").collect()} == pages


def test_run_log_file(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"id":"a","acme_requests":7,"acme_input_tokens" : 9,"acme_cost_usd":0.5,"llm_requests":2,"planner_requests":1,"query":"say \\"x_requests\\": 3"}\n\n{"id":"b","judge_requests":4}\n{oops\n')
    runs, bad = runlog.read_run_log(spark, str(tmp_path))
    rows = {r.id: r for r in runs.collect()}
    assert (rows["a"].judge_requests, rows["a"].judge_input_tokens, rows["a"].judge_cost_usd, rows["a"].llm_requests, rows["a"].planner_requests) == (7, 9, 0.5, 2, 1)
    assert rows["a"].query == 'say "x_requests": 3' and rows["b"].judge_requests == 4 and [r.value for r in bad.collect()] == ["{oops"]


def test_the_judge_of_a_run_log(spark):
    lines = [
        '{"id":"a","judge_requests":5,"search_requests":99}', '{"id":"b","search_requests":99,"judge_requests":5}', '{"id":"c","search_requests":99,"x_cost_usd":1}',
        '{"id":"d","x_requests":1,"x_input_tokens":2,"x_cost_usd":3,"y_requests":4,"y_input_tokens":5,"y_cost_usd":6}', '{"id":"e","x_requests":"many","x_input_tokens":2,"x_cost_usd":3}',
        '{"id":"f","search_requests":99,"x_requests":1,"x_input_tokens":null,"x_cost_usd":3.5}', '{"id":"g","started_at":5,"outcome":"complete"}', '{"id":"torn","started_', "7",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    runs, bad = runlog.parse_run_log(df)
    got = {r.id: (r.judge_requests, r.judge_input_tokens, r.judge_cost_usd) for r in runs.collect()}
    assert got == {"a": (5, 0, None), "b": (5, 0, None), "c": (0, 0, None), "f": (1, 0, 3.5), "g": (0, 0, None)}
    assert sorted(r.value for r in bad.collect()) == sorted([lines[3], lines[4], lines[7], lines[8]])
    runs, bad = runlog.parse_run_log(df, judge="y")
    assert {r.id: r.judge_requests for r in runs.collect()}["d"] == 4 and sorted(r.value for r in bad.collect()) == sorted([lines[7], lines[8]])


def test_run_log_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("")
    runs = spark.createDataFrame([("a", 1_700_000_000)], "id string, started_at long")
    assert not runlog.append_run_log(runs, f"{tmp_path}/file/log")
    assert runlog.append_run_log(runs, f"{tmp_path}/log") and runlog.append_run_log(runs, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 1


def test_named_entities(spark):
    assert each(spark, T.page_text, ["a&dagger;b &euro; &amp;euro; &unknown;"]) == ["a†b € &euro; &unknown;\n"]


def test_answers_by_kind(spark):
    df = spark.createDataFrame([(1, "a" * 100), (2, "b" * 300)], "item_id long, text string").repartition(1)
    questions = [{"id": "c", "kind": "choice", "options": ["x", "y"]}, {"id": "l", "kind": "level", "options": ["no", "some", "most"]}, {"id": "y", "kind": "yes_no"}]
    told = {"choice": {"probabilities": {"x": 0.25, "y": 0.75}}, "level": {"probabilities": {"some": 0.5, "most": 0.5}}, "yes_no": {"score": 0.125}}
    out = {(r.item_id, r.question_id): (r.score, r.choice, r.level) for r in P.answer_with(df, questions, lambda t, q: [told[q["kind"]]] * len(t), 200).collect()}
    assert out == {(1, "c"): (0.75, "y", None), (1, "l"): (0.75, "some", 1), (1, "y"): (0.125, None, None)}


def test_repaired_json(spark):
    rows = [(1, '{"a": 1}'), (2, '```json\n{"a": "}"}\n```'), (3, 'x {"a": [{"b": 1}, {"c": '), (4, "none"), (5, None)]
    out = {r.id: (r.json, r.repair_kind) for r in P.repair_json(spark.createDataFrame(rows, "id long, response string")).collect()}
    assert out == {1: ('{"a": 1}', "whole"), 2: ('{"a": "}"}', "object"), 3: ('{"a": [{"b": 1}]}', "cut"), 4: (None, "none"), 5: (None, "none")}


def test_claims():
    text = "It grew 3.5 % in the U.S. last year [1]. Acme Inc. said e.g. \"yes.\" Wait... really? ```a. b. c``` Done."
    assert P._claims(text) == ["It grew 3.5 % in the U.S. last year [1].", 'Acme Inc. said e.g. "yes."', "Wait... really?", "```a. b. c``` Done."]


def test_markdown_links():
    text = 'See [a [b]](https://x.org/1 "t"), [mail](mailto:a@b.c) and https://y.org/2. Again [c](https://x.org/1)'
    assert P._markdown(text) == [("https://x.org/1", "a [b]"), ("https://y.org/2", "")]


def test_markdown_of_long_texts():
    start = time.monotonic()
    assert P._markdown("[" * 200_000 + "a](https://x.org/1)" + " https://y.org/2") == [("https://x.org/1", "a"), ("https://y.org/2", "")]
    assert time.monotonic() - start < 20


def test_page_queries_read_whole_texts(spark, tmp_path):
    text = "word " * 60 + "[late](https://late.example.org/) " + "word " * 60_000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"<p>{text}</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert "https://late.example.org/" in {x.href for x in page_plans.markdown_links(spark, str(tmp_path)).collect()}
    assert sum(x.chars for x in page_plans.chunk_pages(spark, str(tmp_path)).collect()) > 299_000


def test_packed_batches(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 5, 5, 30, 1, 1, 1])], "g string, item_id long, chars long")
    out = {r.item_id: r.batch for r in P.pack_batches(df, "g", 3, 12).collect()}
    assert out == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3}


def test_limiter():
    import pandas as pd

    frame = pd.DataFrame({"at": list(range(12)) + [61, 70], "id": range(14), "failed": True})
    refused, held = J.throttled(frame, [], 10, 60)
    assert refused == [False] * 10 + [True, True] + [False, False] and len(held) == 2


def test_oversize_items_have_no_score(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "b" * 200), (3, "c")], "item_id long, text string").repartition(1)
    out = {r.item_id: r.score for r in P.score_with(df, lambda t: t.str.len() / 100, 100).collect()}
    assert out == {1: 0.1, 2: None, 3: 0.01}


def plain_merge(rows):
    """One query's hits, lane after lane, by the sequential rule."""
    kept, claims = {}, {}
    for lane, lane_ord, pos, url, title, snippet, key, tkey, stem in sorted(rows, key=lambda r: (r[1], r[2])):
        if not url:
            continue
        if key in kept:
            k = kept[key]
            k["pos"], k["engines"] = min(k["pos"], pos), k["engines"] | {lane}
            k["snippet"] = snippet if len(snippet) > len(k["snippet"]) else k["snippet"]
            k["title"] = k["title"] if k["title"].strip() else title
        elif not (len(tkey.split()) >= 4 and claims.get(tkey, stem) != stem):
            claims.setdefault(tkey, stem)
            kept[key] = {"pos": pos, "engines": {lane}, "snippet": snippet, "title": title, "first": (lane_ord, pos)}
    order = sorted(kept, key=lambda k: (kept[k]["pos"], -len(kept[k]["engines"]), kept[k]["first"]))
    return [(k, kept[k]["pos"], tuple(sorted(kept[k]["engines"])), kept[k]["title"], kept[k]["snippet"]) for k in order]


def test_merging_equals_the_plain_rule(spark, sf):
    from pagefacts.plans import fixtures

    df = fixtures.hits(spark, sf).dropDuplicates(["query", "lane_ord", "pos"])
    odd = [(-1, "a", 0, 1, "", "No address here at all", "s"), (-1, "a", 0, 2, None, "No address either at all", "s"), (-1, "b", 1, 1, "https://x.org/1", " ", "s"), (-1, "b", 1, 2, "https://x.org/1/", "A title of four words", "tt"), (-1, "b", 1, 3, "https://y.org/1", "A title of four words", "")]
    df = df.select("query", "lane", "lane_ord", "pos", "url", "title", "snippet").union(spark.createDataFrame(odd, "query long, lane string, lane_ord int, pos int, url string, title string, snippet string"))
    keyed = H._keyed(df).select("query", "lane", "lane_ord", "pos", "url", "title", "snippet", "key", "tkey", "stem").collect()
    by = {}
    for r in keyed:
        by.setdefault(r.query, []).append(tuple(r)[1:])
    got = {}
    for r in H.merge_hits(df).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.key, r.pos, tuple(r.engines), r.title, r.snippet))
    assert got == {q: plain_merge(rows) for q, rows in by.items()} and [x[0] for x in got[-1]] == ["x.org/1", "y.org/1"]


def test_components_of_all_parts(spark, sf):
    """The query over the whole of ``part`` equals a walk over its pairs."""
    from pagefacts.plans import records as plans

    pairs = [(r.a, r.b) for r in plans.X._columns(spark.read.parquet(f"{sf}/part.parquet"), plans._PAIRS).collect() if r.score >= (1.0 if r.kind == "email" else 1.5)]
    low = {}
    find = lambda x: x if low.setdefault(x, x) == x else find(low[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in plans.merge_groups(spark, sf).collect()} == {x: find(x) for x in list(low)}
