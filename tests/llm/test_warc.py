import hashlib
import random
import uuid

from daygrid.llm.warc import page_records, pieces, read_warc, write_warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
LONG = "x" * 500 + FAKE * 5 + "WARC/1.1\r\n" + "é" * 900 + "\r\n\r\n"


def test_round_trip_with_magic_inside_payloads(spark, tmp_path):
    choices = [None, "", "a" * 700, LONG, FAKE, "WARC/1.1\r\n", "y" * 1500, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", "é" * 40000]
    rows = [(i, f"http://a/{i}" if i % 3 else None, random.Random(i).choice(choices) if i % 5 else LONG + str(i)) for i in range(90)]
    rows.append((90, "u\r\nX: y", "z"))
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, payload string, start int").coalesce(2)
    path = str(tmp_path / uuid.uuid4().hex)
    write_warc(df, path)
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("3000", "100")):
            spark.conf.set(n, v)
        assert pieces(spark, path).select("file", "block").distinct().count() > 10  # records cross blocks
        got = sorted(map(tuple, page_records(read_warc(spark, path)).collect()), key=str)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    last = {h or "": i for i, _, h in rows}
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and last[h or ""] != i
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    assert got == sorted(expected, key=str)


def test_repeated_and_missing_ids_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "p" * 1200), (1, "u", "p" * 1200), (None, "u", "p" * 1200), (None, None, "q" * 1200), (None, None, "q" * 1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "a"))
    got = page_records(read_warc(spark, str(tmp_path / "a"))).collect()
    assert len(got) == 5 and {r["payload_bytes"] for r in got} == {1200} and all(r["record_type"] == "response" for r in got)
    write_warc(df.limit(0), str(tmp_path / "b"))
    assert read_warc(spark, str(tmp_path / "b")).count() == 0
