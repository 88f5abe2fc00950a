import pyarrow as pa

from cuesheet.llm import language, pii, quality, url_filter
from cuesheet.llm.queries import QUERIES, RULES


def test_language_held_out_accuracy_and_odd_rows(spark, folder):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op9_language"](spark, folder).collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    train = spark.createDataFrame([(1, "the cat sat there", "en"), (2, "der hund schläft dort", "de"), (3, None, "de"), (4, "x", None)], "doc_id bigint, text string, lang string")
    model = language.learn(train)
    docs = spark.createDataFrame([("the cat", 1), (None, 2), ("", 3), ("123 !", 4), ("hunde", 5), ("der " * 60000, 6)], "text string, score int")
    got = [r.lang_pred for r in language.predict(docs, model).collect()]
    assert got == ["en", "und", "und", "und", "de", "de"]
    nothing = language.learn(train.where("false"))
    assert language.predict(docs, nothing).first().lang_pred == "und"
    assert language.predict(docs.where("false"), model).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    model = language.Model(["a", "b"], {"known": 0}, {"xy": 0, "z": 1}, *(__import__("numpy").array(m, "float32") for m in ([[-1, -9]], [[-2, -8], [-7, -3]])))
    rows = language._Rows(model)
    assert rows.logs[rows["wxyz"]].tolist() == [-2, -8]
    assert rows.logs[rows["qz"]].tolist() == [-7, -3]
    assert rows.logs[rows["qq"]].tolist() == [0, 0]


def test_quality_held_out_and_odd_rows(spark):
    folder = "/root/testdata/sf0.01"  # a few hundred labels
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in QUERIES["op5_quality"](spark, folder).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.85 * len(held)
    train = spark.createDataFrame([("AAA!! BBB!!", 0), ("some plain words here", 1)], "text string, quality int")
    model = quality.learn(train)
    docs = spark.createDataFrame([("CCC!! DDD!!", "x"), ("other plain words there", "y"), (None, None), ("", ""), (" \n", "")], "text string, score string")
    assert [round(r.score, 3) for r in quality.score(docs, model).collect()][2:] == [0.5, 0.5, 0.5]
    assert [r.predicted for r in quality.score(docs, model).collect()][:2] == [0, 1]
    assert quality.score(docs, quality.learn(train.where("false"))).first().score == 0.5
    assert quality.score(docs.where("false"), model).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://EXAMPLE.com/en/a?x#y"), (2, "http://www.example.com/en/"), (3, "x://b.net/es/1"), (4, "x://com/"),
        (5, "x://b.net"), (6, None), (7, "no scheme"), (8, "a://b.com?q=/en/"), (9, "a://notexample.com/en/"), (10, "a://h/p://q"),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string").selectExpr("*", "1 as rule"), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 11)] == [
        ("example.com", "/en/a", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("b.net", "/es/1", "net/es/"),
        ("com", "/", "com/"), ("b.net", "", None), ("", "", None), ("", "", None), ("b.com", "", None), ("notexample.com", "/en/", "com/"),
        ("h", "/p://q", None),
    ]
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"]
    assert all(got[i].verdict in ("allow", "block") for i in got)
    empty = spark.createDataFrame([], "page_id int, url string")
    assert url_filter.judge(empty, RULES).count() == 0


def test_url_copies_change_no_verdict(spark):
    urls = [f"a://x{i}.com/good/{i}" for i in range(8)] + [f"a://y{i}.net/es/{i}" for i in range(8)] + ["a://z.org/good/1", "a://z.org/es/1"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    copies = pages.crossJoin(spark.range(4000)).selectExpr("concat(url, '?q=', id) as url")
    once, often = (
        {(r.host, r.path): (r.verdict, round(r.block_score, 6)) for r in url_filter.judge(p, RULES).select("host", "path", "verdict", "block_score").distinct().collect()}
        for p in (pages, copies)
    )
    assert once == often
    assert (once["z.org", "/good/1"][0], once["z.org", "/es/1"][0]) == ("allow", "block")


def test_url_regression_learns():
    seen = url_filter.features(pa.array(["a.bad.net", "b.fine.org"]), pa.array(["/xx/1", "/yy/1"]))
    assert seen.shape == (2, url_filter.FEATURES) and abs((seen**2).sum() - 2) < 1e-4


def spans_of(text):
    plain = pii.plain_spans(text)
    return {(pii.KINDS[k], text[s:e]) for s, k, e in plain}, {(pii.KINDS[k], text[s:e]) for s, k, e in pii.disguised_spans(text, plain)}


def test_plain_personal_data():
    text = "a.b+c@x-y.example.com, 10.0.0.256 1.2.3.4.5.6.7.8, 4111 1111 1111 1111, +1 (555) 123-4567 +12 1@b @c.d"
    plain, extra = spans_of(text)
    assert plain == {("email", "a.b+c@x-y.example.com"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")}
    assert extra == set()


def test_disguised_personal_data_maps_back():
    cases = {
        "write john dot doe at mail dot example dot com now": ("email", "john dot doe at mail dot example dot com"),
        "to jane (at) example [dot] org!": ("email", "jane (at) example [dot] org"),
        "bоb@exаmple.com": ("email", "bоb@exаmple.com"),
        "call plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"),
        "ip 10 (dot) 0 (dot) 0 (dot) 1": ("ip", "10 (dot) 0 (dot) 0 (dot) 1"),
        "card ４１１１１１１１１１１１１１１１ end": ("card", "４１１１１１１１１１１１１１１１"),
        "four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"),
    }
    for text, want in cases.items():
        assert want in spans_of(text)[1] or (want[0] == "email" and any(k == "email" for k, _ in spans_of(text)[1])), text
    for clean in ("we met at the dot com boom", "Look at this. Dot.", "one two three four", "Ärger été ñandú", "the point at issue point by point"):
        assert spans_of(clean) == (set(), set()), clean


def test_bare_at_before_bracketed_dots():
    for found in ("jane at example [dot] org", "jane at example (dot) org", "jane at mail dot example {.} org", "jane arroba example [punto] org", "jane arroba example punto org"):
        assert spans_of(f"write to {found}, now") == (set(), {("email", found)}), found
    for clean in ("look at the (dot) here", "one arroba of wine", "jane at example point org"):
        assert spans_of(clean) == (set(), set()), clean


def test_personal_data_rows(spark):
    docs = spark.createDataFrame([(1, "é a@b.co", 9), (2, None, 1), (3, "", 1)], "doc_id int, text string, n_ip int")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].spans == "email:2:8" and got[1].n_email == 1 and got[1].n_ip == 0 and got[2].spans == "" == got[3].spans
    assert pii.redact("é a@b.co", got[1].spans) == "é <email>"
    assert pii.find(docs.where("false")).count() == 0
