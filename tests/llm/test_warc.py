"""Archives: exact round trip, layout, validation and edge cases."""

import hashlib

import pytest
import zstandard

from tracefuse.llm import warc

PAGE = "page_id long, url string, html string"
BIG = "<p>the same payload</p>" * 20


def rows():
    out = [(i, f"http://x/{i}", f"<p>page {i} of the set</p>" * (i % 7 + 1)) for i in range(300)]
    out += [(500 + i, "http://copy/\n", BIG) for i in range(40)] + [(400, None, BIG), (400, None, BIG)]
    return out + [(600, "u", "tiny"), (601, "u", "tiny"), (602, None, None), (None, "u", BIG), (None, None, None), (603, "", "é\x00\r\n\r\n" * 50)]


def test_round_trip(lspark, tmp_path):
    df = lspark.createDataFrame(rows(), PAGE).selectExpr("*", "1 as digest", "2 as payload", "3 as first_id").repartition(3)
    got = warc.archive_round_trip(df).collect()
    want = []
    for i, _, h in rows():
        data = (h or "").encode()
        copy = h == BIG and i != 400
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", 400 if copy else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    path = str(tmp_path / "a")
    warc.write_archives(df, path)
    back = warc.read_archives(lspark, path).collect()
    payloads = sorted(((r.page_id, bytes(r.payload)) for r in back if r.record_type == "response"), key=str)
    assert payloads == sorted(((i, (h or "").encode()) for i, _, h in rows() if h != BIG or i == 400), key=str)


def test_layout_dictionary_leads_one_frame_per_record():
    records = [warc.build_record(i, "u", b"<p>some page text here</p>" * 5 + b"%d" % i, "d", None, False) for i in range(500)]
    data = warc.SEPARATOR.encode().join(warc.encode_archive(iter(records)))
    kinds = [k for k, _ in warc.split_frames(memoryview(data))]
    assert kinds == ["dict"] + ["frame"] * 500 and data[:4] == bytes.fromhex("5d2a4d18")
    # a dictionary may be stored compressed or plain
    lead, trained = warc.dictionary_frame(records)
    raw = trained.as_bytes()
    assert warc.load_dictionary(raw).dict_id() == warc.load_dictionary(lead[8:]).dict_id() != 0


def archive(record: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(record)


def test_validation():
    good = warc.build_record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, False)
    assert [(p, n) for _, p, n in warc.decode_archive(archive(good) * 2)] == [(b"body", 4)] * 2
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"x", good[:-1],
                good.replace(b"body", b"b0dy"), good.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n"),
                good.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: x\r\n"),
                good.replace(b"X-Page-ID: ", b"X-Page-ID ")):
        with pytest.raises(warc.WarcError):
            list(warc.decode_archive(archive(bad)))
    for broken in (archive(good)[:-3], b"\x00" * 12, archive(good) + b"abc", b"\x5d\x2a\x4d\x18\xff\x00\x00\x00"):
        with pytest.raises(warc.WarcError):
            list(warc.decode_archive(broken))
    with pytest.raises(warc.WarcError):
        list(warc.split_frames(memoryview(archive(good) + b"\x5d\x2a\x4d\x18\x00\x00\x00\x00")))


class Pieces:
    """A stream that gives at most a few bytes at a time and remembers the most it was asked to hold."""

    def __init__(self, data, step):
        self.data, self.step, self.at = data, step, 0

    def read(self, n):
        piece = self.data[self.at:self.at + min(n, self.step)]
        self.at += len(piece)
        return piece


def test_streams_in_pieces():
    pages = [b"<p>text of page</p>" * (i % 50) + b"%d" % i for i in range(300)]
    records = [warc.build_record(i, "u", p, hashlib.sha256(p).hexdigest(), None, False) for i, p in enumerate(pages)]
    sep = warc.SEPARATOR.encode() + b"\x51\x2a\x4d\x18\x05\x00\x00\x00extra"
    data = sep.join(warc.encode_archive(iter(records)))
    whole = list(warc.decode_archive(data))
    assert len(whole) == 300
    for step in (1, 7, 1000):
        source = Pieces(data, step)
        first = next(warc.decode_archive(source))
        assert first == whole[0] and source.at < len(data) / 2  # no more than its frame was read
        assert list(warc.decode_archive(Pieces(data, step))) == whole
        assert [k for k, _ in warc.split_frames(Pieces(data, step))] == [k for k, _ in warc.split_frames(data)]
    for cut in (3, 6, len(data) - 1, len(data) // 2):
        with pytest.raises(warc.WarcError):
            list(warc.decode_archive(Pieces(data[:cut], 5)))


def test_archives_by_path_and_as_rows(lspark, tmp_path, monkeypatch):
    folder = tmp_path / "odd name %41 é"
    folder.mkdir()
    for k in range(3):
        records = (warc.build_record(10 * k + i, "u", b"page", hashlib.sha256(b"page").hexdigest(), None, False) for i in range(5))
        (folder / f"a{k}.warc.zst").write_bytes(warc.SEPARATOR.encode().join(warc.encode_archive(records)))
    (folder / "empty.warc.zst").write_bytes(b"")
    want = [(10 * k + i, b"page") for k in range(3) for i in range(5)]
    read = warc.read_archives(lspark, str(folder))
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in scan  # no content through the JVM
    assert sorted((r.page_id, bytes(r.payload)) for r in read.collect()) == want
    monkeypatch.setattr(warc, "STREAMED", ())
    assert sorted((r.page_id, bytes(r.payload)) for r in warc.read_archives(lspark, str(folder)).collect()) == want


def test_empty(lspark):
    df = lspark.createDataFrame([], PAGE)
    assert warc.archive_round_trip(df).count() == 0
