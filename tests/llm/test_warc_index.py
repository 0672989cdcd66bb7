import base64
import hashlib
import random

from quaystone.llm.common import shared_dir
from quaystone.llm.files import Reader
from quaystone.llm.warc_index import archived_pages, block_range, look_up, parse_record, quoted, unquoted, url_key, write_archive


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows, least=0):
    top = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        r = top.get(h or "")
        refers = r if p is not None and r is not None and p < r and len(b) >= least else None
        out.append((p, len(b), digest(b), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def cases():
    rng = random.Random(4)
    html = ["<p>é</p>", "", None, "x" * 100000, "<html>\r\n\r\nWARC/1.1\r\n</html>"]
    rows = [(i, rng.choice(["http://a.example/x y?q=1%20", "https://WWW.B.example:443/p#f", f"http://h{i % 7}.c.example:8080/{i}", None, "", "no scheme", "http://a.example/é\n"]), rng.choice([*html, f"page {i % 40}"])) for i in range(400)]
    return rows + [(None, "http://n.example/", "page 3"), (5, rows[5][1], rows[5][2])]


def test_round_trip_against_brute_force(spark):
    df = spark.createDataFrame([(p, u, h, "k") for p, u, h in cases()], "page_id long, url string, html string, key string")
    assert rows_of(archived_pages(spark, df, shared_dir(spark))) == brute(cases())
    base = shared_dir(spark)
    index = write_archive(df, base, min_revisit_bytes=5, lines_per_block=3)
    assert rows_of(look_up(df, base, index)) == brute(cases(), 5)


def test_look_up_some_urls_with_payloads(spark):
    df = spark.createDataFrame(cases(), "page_id long, url string, html string")
    base = shared_dir(spark)
    index = write_archive(df, base, lines_per_block=2)
    asked = spark.createDataFrame([("http://www.a.example/x y?q=1%20",), ("http://nowhere.example/",)], "url string")
    got = look_up(asked, base, index).collect()
    want = {p: (u, h) for p, u, h in cases() if u and url_key(u) == url_key("http://a.example/x y?q=1%20")}
    assert {r.page_id for r in got} == set(want)
    for r in got:
        assert r.url == want[r.page_id][0]
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (want[r.page_id][1] or "")


def test_files_are_readable_records(spark):
    base = shared_dir(spark)
    write_archive(spark.createDataFrame([(1, "http://a.example/", "hello")], "page_id long, url string, html string"), base)
    line = spark.read.parquet(f"{base}/lines").first()
    headers, payload = parse_record(bytes(Reader(f"{base}/{line.file}").read(line.at, line.length)))
    assert payload == b"hello" and headers["WARC-Target-URI"] == "http://a.example/" and headers["WARC-Type"] == "response"


def test_keys_and_search(spark):
    assert url_key("https://www.News.Example.com:443/a?b=1#c") == "com,example,news)/a?b=1" == url_key("http://news.example.com/a?b=1")
    assert url_key("http://u@h.example:81") == "example,h:81)/" and url_key(None) == "" == url_key("")
    assert unquoted(quoted("a b%20\n")) == "a b%20\n"
    assert block_range(["b", "d", "d", "f"], "d") == (0, 3) and block_range(["b", "d"], "a") == (0, 0) and block_range(["b", "d"], "c") == (0, 1)
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived_pages(spark, df, shared_dir(spark)).count() == 0
