"""Exact round trips: chat formatting and archives."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from kmerspark.llm import chat, warc

TEXT = st.lists(st.sampled_from([*chat.CONTROLS, "\\", " ", "x", "\n", "é", "[", "<", ">", "]"]), max_size=12).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_rendered_turns_parse_back(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


def test_clean_text_is_not_escaped():
    assert chat.render("user", "back\\slash [x] <b>") == "[INST] back\\slash [x] <b> [/INST]"
    assert chat.render("assistant", "a </s> b") == " a \\</s> b </s>"
    with pytest.raises(ValueError):
        chat.parse("[INST] open")


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, None, None), (2, 1, "assistant", "b"), (2, 0, "assistant", "a\\<s>"), (2, 1, "assistant", "b"), (None, None, "tool", "<<ROLE>>"), (3, 0, "system", "s " * 50_000)]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    out = {r.conv_id: r for r in chat.round_trip(df).collect()}
    assert set(out) == {1, 2, 3, 9, None}
    for c, r in out.items():
        own = sorted(((t if t is not None else -1, a or "", b or "") for i, t, a, b in rows if i == c))
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len("<s>" + "".join(chat.render(a, b) for _, a, b in own))
    assert chat.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    data = warc.arc_opening(version, "x.arc", "19970101000000") + warc.arc_record(version, "http://a/", "19970101000000", b"HTTP/1.1 200 OK\r\n\r\n\n\nbody\n") + warc.arc_record(version, "-", "19970101000000", b"")
    got = list(warc.parse_arc(data))
    assert [b for *_, b in got] == [b"HTTP/1.1 200 OK\r\n\r\n\n\nbody\n", b""] and got[0][1]["URL"] == "http://a/"
    for broken in (data[:-3] + b"xx\n", data.replace(b"URL IP", b"URI IP"), data[: len(data) - 2]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=4), st.integers(1, 50))
def test_warc_parsing_in_pieces(blocks, step):
    raw = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for b in blocks)
    assert [b for _, b in warc.parse_warc(raw[i : i + step] for i in range(0, len(raw), step))] == blocks


def test_archives_read_back(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "u", big), (4, "u\n", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (3, "again", big), (None, "n", big), (None, "n", "z"), (8, "long", "q" * 3_000_000)]
    out = sorted(map(str, map(tuple, warc.convert(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bytes int")).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h == big and i != 3
        want.append(str((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None)))
    assert out == sorted(want)
    assert warc.convert(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_foreign_archives(spark, tmp_path):
    page = "HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\ncaf\xe9 ".encode("latin-1") + b"\x00\xff" * 600
    first = b"filedesc://IA-1.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    record = lambda url, block: f"{url} 9.9.9.9 19960923142103 text/html {len(block)}\n".encode("latin-1") + block + b"\n"
    data = first + record("http://a/\xe9", page) + b"\n" + record("http://b/", page) + record("dns:c", b"1.2.3.4") + record("http://d/", b"HTTP/1.0 204 Empty\r\n\r\n")
    opening = b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
    data = data.replace(b"text/plain 76\n", f"text/plain {len(opening)}\n".encode())
    archives = spark.createDataFrame([("one.arc", data), ("two.arc", data[:-1])], "name string, archive binary")
    path = f"file://{tmp_path}/out"
    warc.write_records(warc.from_archives(archives), path)
    out = warc.read_warc(spark, path).collect()
    body = page.partition(b"\r\n\r\n")[2]
    assert len(out) == 8 and len({r.record_id for r in out}) == 8 and {r.page_id for r in out} == {None}
    assert sorted((r.payload_bytes, r.payload_digest, r.record_type) for r in out) == sorted(
        2 * [(len(body), hashlib.sha1(body).hexdigest(), "response")] * 2 + [(7, hashlib.sha1(b"1.2.3.4").hexdigest(), "resource")] * 2 + [(0, hashlib.sha1(b"").hexdigest(), "response")] * 2
    )


def test_record_ids_are_unique_and_files_bounded(spark, tmp_path, monkeypatch):
    rows = [(i % 3 if i % 5 else None, "same", "<p>" + "z" * (2000 if i % 2 else 90_000 + i)) for i in range(60)]
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    path = f"file://{tmp_path}/out"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    out = warc.read_warc(spark, path).collect()
    assert len(out) == 60 and len({r.record_id for r in out}) == 60
    assert len(list((tmp_path / "out" / "large").glob("*.gz"))) >= 15 and len(list((tmp_path / "out" / "small").glob("*.gz"))) >= 10


def test_gzipped_archives(spark):
    """Members for each record, for several and for all give the records of the plain archive; broken ones raise."""
    import gzip

    opening = warc.arc_opening(1, "x.arc", warc.DATE)
    texts = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n\x1f\x8bbody", b"", bytes(range(256)) * 40]
    parts = [opening, *(warc.arc_record(1, f"http://a/{i}", warc.DATE, t) for i, t in enumerate(texts))]
    by_record, whole = b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))
    some = gzip.compress(b"".join(parts[:2])) + gzip.compress(parts[2] + parts[3][:50]) + gzip.compress(parts[3][50:]) + bytes(9)
    read = lambda data: sorted(tuple(r)[1:] for r in warc.from_archives(spark.createDataFrame([("x", bytearray(data))], "name string, archive binary")).collect())
    plain = read(b"".join(parts))
    assert len(plain) == 3 and all(read(d) == plain for d in (by_record, whole, some))
    for broken in (by_record[:-3], whole + b"junk", by_record[:20] + b"\x00" * 9 + by_record[29:]):
        with pytest.raises(ValueError, match="gzip member"):
            warc.unzipped(broken)
