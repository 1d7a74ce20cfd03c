from __future__ import annotations

import gzip
import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from cropwind.llm import warc
WHOLE = "/root/testdata/sf0.001"

SCHEMA = "page_id long, url string, html string"


def sha(text: str | None) -> str:
    return hashlib.sha1((text or "").encode()).hexdigest()


def by_hand(rows: list[tuple]) -> list[tuple]:
    """One response for each payload of 1000 bytes and more: the row with the largest number."""
    best: dict[str, tuple] = {}
    for i, (page, url, html) in enumerate(rows):
        if len((html or "").encode()) >= 1000:
            key = (page is not None, page or 0, url is not None, (url or "").encode(), i)
            if sha(html) not in best or key > best[sha(html)]:
                best[sha(html)] = key
    out = []
    for i, (page, _, html) in enumerate(rows):
        size = len((html or "").encode())
        revisit = size >= 1000 and best[sha(html)][4] != i
        first = best[sha(html)] if revisit else None
        out.append((str(page), size, sha(html), "revisit" if revisit else "response", str(first[1] if first and first[0] else None)))
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.digest(df).collect())


def test_whole_table(spark):
    df = spark.read.parquet(f"{WHOLE}/pages.parquet")
    assert found(df) == by_hand([tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_groups_of_copies_nulls_repeats_and_clashing_columns(spark):
    big, other, edge = "é" * 500, "z" * 5000, "e" * 1000
    rows = [(1, "u", big), (9, "v", big), (4, "w", big), (7, None, other), (7, "b", other), (7, "a", other), (2, "x", "short"), (3, "x", "short")]
    rows += [(11, "same", edge)] * 3 + [(10, "same", edge)] * 2 + [(5, "q", "e" * 999)] * 2
    rows += [(None, "u", None), (None, None, ""), (None, "n", "n" * 2000), (None, "m", "n" * 2000), (20, "line\r\nbreak: x", "y" * 1200), (21, "long", "<p>" + "w" * 3_000_000), (22, "long", "<p>" + "w" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA + ", digest string, bytes int")
    got = found(df)
    assert got == by_hand(rows)
    assert Counter(r[3] for r in got if r[2] == sha(edge)) == {"response": 1, "revisit": 4}
    assert found(df.where("false")) == []


def test_payloads_with_end_marks_come_back(spark, tmp_path):
    draw = random.Random(5)
    parts = ["\r\n\r\n", "\r\n", "\r", "\n", "WARC/1.1\r\n", "text", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é"]
    texts = ["", *parts, "a\r\n\r\n", "\r\n\r\n\r\n\r\n", "\r\n\r\r\n\r\n", *("".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(300))]
    texts += ["x" * (65_530 + i) + "\r\n\r\n" + "y" * 10 for i in range(12)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", t) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    warc.write(pages, str(tmp_path / "w"), min_bytes=10)
    records = warc.resolved(warc.read(spark, str(tmp_path / "w"))).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in records} == dict(enumerate(texts)) and len(records) == len(texts)
    assert all(r.payload_bytes == len(r.payload) and hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in records)


def test_archives_are_warc(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"page {i % 3} " * 200) for i in range(12)]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    ids, refers, n = set(), set(), 0
    for file in Path(tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
            size = int(fields["Content-Length"])
            block = rest[:size]
            assert rest[size : size + 4] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
            ids.add(fields["WARC-Record-ID"])
            n += 1
            if fields["WARC-Type"] == "revisit":
                refers.add(fields["WARC-Refers-To"])
                assert fields["WARC-Profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n") and int(fields["X-Page-ID"]) < 9
            data = rest[size + 4 :]
    assert n == 12 and len(ids) == 12 and len(refers) == 3 and refers < ids


def test_broken_archives_are_errors():
    good = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:0\r\nContent-Length: 30", b"HTTP/1.1 200\r\nContent-Length: 3", b"abc"]
    with pytest.raises(ValueError, match="begin"):
        list(warc._parsed(iter([b"no archive"]), True))
    with pytest.raises(ValueError, match="inside"):
        list(warc._parsed(iter([good[0].replace(b"30", b"300"), *good[1:]]), True))


def test_original_is_chosen_from_headers_alone(spark):
    df = spark.read.parquet(f"{WHOLE}/pages.parquet")
    plan = warc.originals(warc._captures(df))._jdf.queryExecution().executedPlan().toString()
    assert all("payload" not in line for line in plan.splitlines() if "Exchange" in line)
