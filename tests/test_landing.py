from pyspark.sql import functions as F

from tests.helpers import bodies, rows
from tickerloom import names
from tickerloom.sources import landing

TRADE = {"s": "AAA", "p": 10.5, "t": 1735689600123, "v": 100.0, "c": ["1"]}
ARTICLE = {"uuid": "u1", "title": "T", "description": None, "snippet": "S", "url": "http://x", "image_url": None,
           "language": "en", "published_at": "2025-01-01T00:00:00.000000Z", "source": "x",
           "entities": [{"symbol": "AAA", "name": "A", "exchange": None, "sentiment_score": 0.4},
                        {"symbol": "BBB", "name": "B", "exchange": None, "sentiment_score": None}]}
HEADLINE = {"source": {"id": None, "name": "n"}, "author": None, "title": "New method", "description": "about bitcoin",
            "url": "http://x", "urlToImage": None, "publishedAt": "2025-01-01T00:00:00Z", "content": "c"}
BAR = {"1. open": "10", "2. high": "12", "3. low": "9", "4. close": "11", "5. volume": "1000"}
QUOTE = {"cmd_id": 22999, "data": {"code": "BBBUSDT", "seq": 7, "tick_time": 1735689600123,
                                   "bids": [{"price": "1.5", "volume": "2"}], "asks": []}}


def without(mapping, key):
    return {k: v for k, v in mapping.items() if k != key}


def verdicts(spark, feed, *messages):
    return [r[0] for r in rows(landing.triage(bodies(spark, *messages), feed).select("verdict", "n"), "n")]


def test_trades(spark):
    def message(**change):
        return {"type": "trade", "data": [TRADE, {**TRADE, **change}]}
    cases = [
        (message(), "accepted"),
        ({"type": "ping"}, "dropped"),
        ({"data": [TRADE]}, "dropped"),
        ("not json", "rejected"),
        ({"type": "trade"}, "rejected"),
        ({"type": "trade", "data": [without(TRADE, "s")]}, "rejected"),
        ({"type": "trade", "data": [without(TRADE, "c")]}, "accepted"),
        ({"type": "trade", "data": []}, "accepted"),
        ({"type": "trade", "data": [TRADE, None]}, "rejected"),
        ({"type": "trade", "data": TRADE}, "rejected"),
        (message(p="10.5"), "accepted"),
        (message(p="n/a"), "rejected"),
        (message(t="12"), "accepted"),
        (message(t=12.0), "accepted"),
        (message(t=12.5), "rejected"),
        (message(s=5), "rejected"),
        (message(s=None), "rejected"),
        (message(c=None), "rejected"),
        (message(c=[1]), "rejected"),
        (message(c=["1", None]), "rejected"),
    ]
    got = verdicts(spark, names.TRADES, *[m for m, _ in cases])
    assert got == [v for _, v in cases]


def test_quotes(spark):
    def quote(**change):
        return {**QUOTE, "data": {**QUOTE["data"], **change}}
    cases = [
        (QUOTE, "accepted"),
        ({"cmd_id": 22000, "data": {}}, "dropped"),
        ({"cmd_id": 22003}, "dropped"),
        ({**QUOTE, "cmd_id": "22999"}, "dropped"),
        ({**QUOTE, "cmd_id": 22999.0}, "accepted"),
        ({"data": {}}, "dropped"),
        ({"cmd_id": 22999, "data": without(QUOTE["data"], "asks")}, "accepted"),
        (quote(asks=None), "rejected"),
        (quote(bids=[{"price": 1.5, "volume": "2"}]), "rejected"),
        (quote(bids=[{"price": "1.5"}]), "rejected"),
    ]
    assert verdicts(spark, names.QUOTES, *[m for m, _ in cases]) == [v for _, v in cases]


def test_bars(spark):
    good = {"Meta Data": {"2. Symbol": "AAA", "3. Last Refreshed": "2025-01-02"}, "Time Series (Daily)": {"2025-01-02": BAR}}
    cases = [
        (good, "accepted"),
        ({"Note": "rate limit"}, "dropped"),
        ({**good, "Information": None}, "dropped"),
        ({"Error Message": "no such symbol"}, "dropped"),
        ({}, "rejected"),
        ({**good, "Time Series (Daily)": {"2025-01-02": BAR, "2025-01-03": without(BAR, "4. close")}}, "rejected"),
        ({**good, "Time Series (Daily)": {"2025-01-02": {**BAR, "5. volume": 1000}}}, "rejected"),
        ({**good, "Meta Data": {"2. Symbol": None}}, "rejected"),
    ]
    assert verdicts(spark, names.BARS, *[m for m, _ in cases]) == [v for _, v in cases]


def test_news(spark):
    def entity_news(**change):
        return {"meta": {"found": 1}, "data": [{**ARTICLE, **change}]}
    cases = [
        (entity_news(), "accepted"),
        ({"error": {"message": "limit"}}, "dropped"),
        ({"message": None}, "dropped"),
        ({"meta": {}, "data": [without(ARTICLE, "description")]}, "rejected"),
        (entity_news(title=None), "rejected"),
        (entity_news(entities=[{"symbol": "A", "name": "A", "exchange": None}]), "rejected"),
        (entity_news(entities=[]), "accepted"),
        ({"data": [ARTICLE]}, "rejected"),
    ]
    assert verdicts(spark, names.ENTITY_NEWS, *[m for m, _ in cases]) == [v for _, v in cases]

    def headlines(**change):
        return {"status": "ok", "totalResults": 1, "articles": [{**HEADLINE, **change}]}
    cases = [
        (headlines(), "accepted"),
        ({"status": "error", "message": "key"}, "dropped"),
        (without(headlines(), "status"), "rejected"),
        (headlines(source={"name": "n"}), "rejected"),
        (headlines(source={"id": None, "name": "n"}, extra=1), "accepted"),
        (headlines(publishedAt=None), "rejected"),
    ]
    assert verdicts(spark, names.HEADLINES, *[m for m, _ in cases]) == [v for _, v in cases]


def test_every_body_gets_one_verdict(spark):
    raw = bodies(spark, {"type": "trade", "data": [TRADE]}, {"type": "ping"}, "x", {"type": "trade", "data": 1})
    counts = {(r.verdict, r.reason): r.bodies for r in landing.tally(landing.triage(raw, names.TRADES)).collect()}
    assert counts == {("accepted", None): 1, ("dropped", None): 1, ("rejected", "not JSON"): 1, ("rejected", "data"): 1}


def test_messages_are_canonical(spark):
    raw = bodies(spark, {"type": "trade", "data": [{**TRADE, "extra": 1}, without(TRADE, "c")]})
    out = landing.messages(landing.elements(landing.triage(raw, names.TRADES), names.TRADES), names.TRADES)
    assert rows(out, "value") == [
        ("AAA", '{"s":"AAA","p":10.5,"t":1735689600123,"v":100.0,"c":["1"]}', "raw_finnhub_ticks"),
        ("AAA", '{"s":"AAA","p":10.5,"t":1735689600123,"v":100.0,"c":[]}', "raw_finnhub_ticks")]

    raw = bodies(spark, {"status": "ok", "totalResults": 1, "articles": [HEADLINE]})
    out = landing.messages(landing.elements(landing.triage(raw, names.HEADLINES), names.HEADLINES), names.HEADLINES)
    assert rows(out)[0][:2] == ("New method", (
        '{"source":{"id":null,"name":"n"},"author":null,"title":"New method","description":"about bitcoin",'
        '"url":"http://x","urlToImage":null,"publishedAt":"2025-01-01T00:00:00Z","content":"c"}'))

    raw = bodies(spark, QUOTE)
    out = landing.messages(landing.elements(landing.triage(raw, names.QUOTES), names.QUOTES), names.QUOTES)
    assert rows(out) == [("BBBUSDT", (
        '{"cmd_id":22999,"data":{"code":"BBBUSDT","seq":7,"tick_time":1735689600123,'
        '"bids":[{"price":"1.5","volume":"2"}],"asks":[]}}'), "raw_alltick_ticks")]

    raw = bodies(spark, {"meta": {"found": 1}, "data": [ARTICLE]})
    out = landing.messages(landing.elements(landing.triage(raw, names.ENTITY_NEWS), names.ENTITY_NEWS), names.ENTITY_NEWS)
    assert rows(out)[0][0] == "u1"
    raw = bodies(spark, {"Meta Data": {"2. Symbol": "AAA"}, "Time Series (Daily)": {"2025-01-02": BAR}})
    out = landing.messages(landing.elements(landing.triage(raw, names.BARS), names.BARS), names.BARS)
    assert rows(out)[0][:2] == ("AAA", (
        '{"meta_data":{"2. Symbol":"AAA"},'
        '"time_series":{"2025-01-02":{"open":"10","high":"12","low":"9","close":"11","volume":"1000"}}}'))


def test_selections(spark):
    news = spark.createDataFrame(
        [("a", "Bitcoin up", "en", "2025-01-10 00:00:00"), ("b", "nvidia", "de", "2025-01-10 00:00:00"),
         ("c", "weather", "en", "2025-01-03 00:00:00"), ("d", "Amazon", "en", "2025-01-02 23:59:59")],
        "id string, title string, language string, published string").withColumn("published", F.to_timestamp("published"))
    assert rows(landing.on_topic(news, F.col("title"), F.col("language")).select("id"), "id") == [("a",), ("d",)]
    assert rows(landing.recent(news, F.col("published"), "2025-01-10").select("id"), "id") == [("a",), ("b",), ("c",)]
    assert rows(landing.newest(news, "published", "id", 2).select("id")) == [("a",), ("b",)]
    assert rows(landing.watched(news, "id", ["a", "z"]).select("id")) == [("a",)]
    watch = spark.createDataFrame([("b",), ("b",), ("z",)], "ticker string")
    assert rows(landing.watched(news, "id", watch).select("id")) == [("b",)]


def test_subscriptions(spark):
    def kept(feed, *messages, watch=None):
        rows_of_feed = landing.elements(landing.triage(bodies(spark, *messages), feed), feed)
        out = landing.messages(landing.subscribed(rows_of_feed, feed, watch), feed)
        return [r[0] for r in rows(out.select("key"), "key")]
    assert kept(names.TRADES, {"type": "trade", "data": [TRADE, {**TRADE, "s": "NVDA"}]}) == ["NVDA"]
    assert kept(names.QUOTES, QUOTE) == [] and kept(names.QUOTES, QUOTE, watch=["BBBUSDT"]) == ["BBBUSDT"]
    assert kept(names.BARS, {"Meta Data": {"2. Symbol": "MSFT"}, "Time Series (Daily)": {}}) == ["MSFT"]
    one = {**ARTICLE, "uuid": "u2", "entities": [{**ARTICLE["entities"][0], "symbol": "CC:BTC"}]}
    assert kept(names.ENTITY_NEWS, {"meta": {}, "data": [ARTICLE, one]}) == ["u2"]
    other = {**HEADLINE, "title": "Quiet", "description": None}
    assert kept(names.HEADLINES, {"status": "ok", "totalResults": 2, "articles": [HEADLINE, other]}) == ["New method"]


def test_best_price(spark):
    book = spark.sql("""SELECT * FROM VALUES (1, array(named_struct('price', '5'), named_struct('price', '4'))),
                        (2, cast(array() as array<struct<price: string>>)), (3, null) AS t(n, levels)""")
    assert rows(book.select("n", landing.best_price(F.col("levels"))), "n") == [(1, "5"), (2, "N/A"), (3, "N/A")]


def test_verdicts_are_counted_by_the_write(spark, tmp_path):
    good = {"type": "trade", "data": [TRADE]}
    got = bodies(spark, good, good, "not json", {"type": "ping"}, {"type": "trade", "data": "none"})
    triaged, seen = landing.counted(landing.triage(got, names.TRADES), names.TRADES)
    landing.messages(landing.elements(triaged, names.TRADES), names.TRADES).write.parquet(str(tmp_path / "out"))
    counts = landing.observed_tally(spark, seen, names.TRADES)
    assert sorted(rows(counts), key=repr) == sorted(rows(landing.tally(triaged)), key=repr)
    assert {(r.verdict, r.bodies) for r in counts.collect()} == {("accepted", 2), ("dropped", 1), ("rejected", 1)}
    assert counts.filter("verdict = 'rejected'").count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
