import io
import zlib

from vouch.llm import warc
from vouch.llm.common import shared_folder, written


def test_records_of_any_members():
    one = warc.record_bytes(1, "http://a\r\nX: y", b"abc", "D", None, False)
    two = warc.record_bytes(2, None, b"abc", "D", 1, True)
    packed = lambda b: zlib.compress(b, wbits=31)
    for stream in (packed(one + two), packed(one) + packed(two), packed(b"") + packed(one[:5]) + packed(one[5:] + two)):
        found = list(warc.Records(io.BytesIO(stream)))
        assert [r for _, r in found] == [one, two] and found[1][0]["WARC-Refers-To"] == "<urn:page:1>"


def test_files(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", None), (4, "u4", ""), (5, None, "é\r\n\r\n" * 1000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, single = shared_folder(spark, "w"), shared_folder(spark, "s")
    files = written(warc.write_archives(warc.revisits(pages, "page_id", "html"), whole, most=50), "f")
    index = written(warc.normalise(warc.spread(files), whole, single), "i")
    got = {r.page_id: r for r in warc.read_records(index, single).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4, 5, None)] == ["response", "response", "revisit", "revisit", "response", "revisit"]
    assert [got[i].refers_to for i in (1, 3, 4, None)] == [None, 1, 2, 1] and got[3].payload_bytes == 4
    assert bytes(got[5].payload).decode() == rows[4][2] and got[3].payload is None
    # Each record is a gzip member of its own at its offset, and the sidecar index says the same.
    fs, path = warc.store(single)
    for r in index.collect():
        with fs.open_input_file(f"{path}/{r.archive}") as f:
            head = zlib.decompress(f.read_at(r.length, r.offset), 31)
        assert r.record_id.encode() in head and head.startswith(b"WARC/1.1\r\n")
    sidecars = [x for x in fs.get_file_info(warc_selector(path)) if x.path.endswith(".idx")]
    assert len(sidecars) == index.select("archive").distinct().count()
    assert warc.read_records(index.limit(0), single).count() == 0


def warc_selector(path):
    from pyarrow import fs

    return fs.FileSelector(path)


def test_small_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], "page_id long, html string")
    assert {r.page_id: r.refers_to for r in warc.revisits(pages, "page_id", "html", least=3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_query(twin):
    twin(warc, "op3_warc")
