import base64
import hashlib
import os
import random

import zstandard

from topiclake.llm import warc

SCHEMA = "page_id long, url string, html string, kept string"


def brute(rows, least=0):
    last = {}
    for page, _, html, _ in rows:
        h = html or ""
        if h not in last or last[h] is None or (page is not None and page > last[h]):
            last[h] = page
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = page != last[html or ""] and len(data) >= least
        out.append((page, len(data), digest, "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return out


def rows():
    rng = random.Random(1)
    pages = [f"<html><body><p>{' '.join(rng.choices(['one', 'two', 'é', '中'], k=40))}</p></body></html>" for _ in range(20)]
    out = [(i, f"http://host/{i}", rng.choice(pages), "x") for i in range(120)]
    out += [(200, None, None, "x"), (201, "a b\r\nc", "", "x"), (None, "http://n/", pages[0], "x"), (None, None, "only null", "x")]
    out += [(300, "http://z/", "y" * 2_000_000, "x"), out[0], out[0]]
    return out


def read(spark, folder, data, least=0):
    pages = spark.createDataFrame(data, SCHEMA)
    archives = warc.write_archives(pages, str(folder), least_bytes=least)
    found = warc.read_archives(archives, str(folder)).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(
        (
            (None if r.page is None else int(r.page), r.payload_bytes, r.payload_digest, r.record_type,
             None if r.refers_to is None else int(r.refers_to))
            for r in found
        ),
        key=key,
    )
    return archives, got, sorted(brute(data, least), key=key)


def test_round_trip(spark, tmp_path):
    archives, got, expected = read(spark, tmp_path, rows())
    assert got == expected
    listed = archives.collect()
    assert sum(a.records for a in listed) == len(expected)
    for a in listed:
        assert os.path.getsize(a.archive) == a.bytes
        with open(a.archive, "rb") as file:
            data = file.read()
        # A leading skippable frame with the dictionary, then a frame per record.
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[8 + size :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: re")


def test_small_payloads_are_responses(spark, tmp_path):
    _, got, expected = read(spark, tmp_path, rows(), least=100)
    assert got == expected


def test_empty_and_tiny(spark, tmp_path):
    assert read(spark, tmp_path / "a", [])[1] == []
    _, got, expected = read(spark, tmp_path / "b", [(1, "u", None, "x")])
    assert got == expected


def test_dictionary_of_few_samples():
    assert warc.build_dictionary([]) == b""
    assert warc.build_dictionary([b"abc", b""]) == b"abc"


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "cut.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(b"x" * 100)[:-3])
    with open(path, "rb") as file:
        try:
            list(warc.frames(file))
        except ValueError as e:
            assert "ends inside" in str(e)
        else:
            raise AssertionError("a cut archive was read")
