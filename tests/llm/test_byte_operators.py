"""FLAC, WARC, personal data, licenses and URL filters: round trips and brute force."""

import base64
import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import license_scan, media, pii, url_filter, warc

TEXTS = [None, "", "a", "Ünï¢ode text " * 90, " " * 500, "word " * 3000, "same", "same", "\x00\x7f" * 50]


def padded(text):
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 192)) * 192)


def test_flac_query_round_trip(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no id")], "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in media.judge(media.stored(docs)).collect()}
    assert len(got) == len(TEXTS) + 1
    for k, text in enumerate(TEXTS):
        p, r = padded(text), got[k]
        stream = media.encode([p])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert got[6].feature == got[7].feature


def test_flac_blocks_are_seekable(spark):
    docs = spark.createDataFrame([(1, "abc " * 20000)], "doc_id long, text string")
    raw = media.stored(docs).first().media
    rows = sorted(media.blocks(media.stored(docs)).collect(), key=lambda r: r.block)
    assert b"".join(r.pcm for r in rows) == padded("abc " * 20000)
    assert [r.sample_offset for r in rows] == [192 * k for k in range(len(rows))]
    at = media.seek(raw, rows[130].sample_offset)
    assert at == rows[128].byte_offset and raw[at : at + 2] == b"\xff\xf8"


@pytest.mark.parametrize("seed", range(4))
def test_flac_any_bytes_and_damage(seed):
    rng = np.random.default_rng(seed)
    payloads = [rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 2, 130)] + [bytes(192), b"\xff\xf8\x14\x02" * 48 * 5, bytes([0, 255]) * 96]
    streams = media.encode(payloads)
    for p, raw, (_, samples, at) in zip(payloads, streams, media.decode(streams), strict=True):
        assert (samples + 128).astype(np.uint8).tobytes() == p
        alone = media._sequential(raw)
        assert (alone[1] == samples).all() and (alone[2] == at).all()
    for place in (30, 300, -40, -3):
        bad = bytearray(streams[2])
        bad[place] ^= 0x10
        with pytest.raises(media.FlacError):
            media.decode([bytes(bad)])


def test_flac_damage_is_a_row(spark):
    good = media.encode([padded("some text " * 300)])[0]
    bad = bytearray(good)
    bad[200] ^= 4
    raws = [good, None, b"", b"fLaC", good[:60], good[:-5], bytes(bad), good]
    rows = spark.createDataFrame([(k, 3000, r) for k, r in enumerate(raws)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.judge(rows).collect()}
    assert [bool(got[k].error) for k in range(8)] == [False] + [True] * 6 + [False]
    assert got[0].payload_sha256 == got[7].payload_sha256 == hashlib.sha256(padded("some text " * 300)).hexdigest() and got[6].payload_sha256 is None
    parts = collections.Counter((r.doc_id, r.error is None) for r in media.blocks(rows).collect())
    assert parts == {(0, True): 16, (7, True): 16} | {(k, False): 1 for k in range(1, 7)}
    assert media.judge(rows.limit(0)).count() == media.blocks(rows.limit(0)).count() == 0


def test_flac_linear_prediction_pays_where_it_fits():
    t = np.arange(192 * 20)
    tone = (128 + 60 * np.sin(t / 9) + 40 * np.sin(t / 4.1)).astype(np.uint8).tobytes()
    kinds = {}
    for name, p in (("tone", tone), ("silence", bytes([128]) * 1920), ("text", padded("the quick brown fox jumps over the lazy dog " * 90))):
        raw = media.encode([p])[0]
        (meta, samples, at), = media.decode([raw])
        assert (samples + 128).astype(np.uint8).tobytes() == p
        kinds[name] = {(raw[a + 6] >> 1) & 63 for a in at.tolist()}
    assert 0x20 | (media.LPC - 1) in kinds["tone"] and 0x20 | (media.LPC - 1) in kinds["text"]


def test_media_query_stores_and_reads_back(spark, tmp_path, monkeypatch):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, TEXTS[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names, real = [], media.store
    monkeypatch.setattr(media, "store", lambda df, name, **kw: names.append(name) or real(df, name, **kw))
    got = media.op10_media(spark, str(tmp_path)).collect()
    want = collections.Counter((k, hashlib.sha256(padded(t)).hexdigest(), hashlib.sha256(media.encode([padded(t)])[0]).hexdigest()) for k, t in rows)
    assert collections.Counter((r.doc_id, r.payload_sha256, r.media_sha256) for r in got) == want
    assert names == ["media", "features"] * media.PARTS


def _frame(bits: str, number: int = 0) -> bytes:
    head = bytes([0xFF, 0xF8, 0x14, 0x02, number])
    head += bytes([int(media.crc8(np.frombuffer(head.ljust(12, b"\0"), np.uint8)[None], np.array([5]))[0])])
    raw = head + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return raw + int(media.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")


def _stream(samples, frames: list[bytes]) -> bytes:
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | (192 * len(frames))).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def _b(value, width):
    return format(value & ((1 << width) - 1), f"0{width}b")


def _rice(values, k):
    out = ""
    for v in values:
        u = (v << 1) ^ (v >> 31)
        out += "0" * (u >> k) + "1" + (_b(u, k) if k else "")
    return out


def test_flac_other_subframes():
    x = [(7 * k * k // 5 + k) % 90 - 45 for k in range(192)]
    constant = _frame("0" + "000000" + "0" + _b(-5, 8))
    verbatim = _frame("0" + "000001" + "0" + "".join(_b(v, 8) for v in x), 1)
    # second-order LPC with two partitions, of which the second escapes to raw values
    factors, shift = (7, -3), 2
    rest = [x[j] - ((x[j - 1] * factors[0] + x[j - 2] * factors[1]) >> shift) for j in range(2, 192)]
    lpc = "0" + "100001" + "0" + _b(x[0], 8) + _b(x[1], 8) + _b(3, 4) + _b(shift, 5) + _b(factors[0], 4) + _b(factors[1], 4)
    lpc += "00" + _b(1, 4) + _b(5, 4) + _rice(rest[:94], 5) + "1111" + _b(10, 5) + "".join(_b(v, 10) for v in rest[94:])
    cubic = [int(v) for v in np.diff(x, 3)]
    fixed = "0" + "001011" + "0" + "".join(_b(v, 8) for v in x[:3]) + "00" + "0000" + _b(4, 4) + _rice(cubic, 4)
    raw = _stream([-5] * 192 + x * 3, [constant, verbatim, _frame(lpc, 2), _frame(fixed, 3)])
    assert media.decode([raw])[0][1].ravel().tolist() == [-5] * 192 + x * 3


@pytest.mark.parametrize("n", [1, 50, 191])
def test_flac_short_last_block(n):
    raw, tail = media.encode([bytes(range(192)) * 3])[0], bytes(range(7, 7 + n))
    meta = media._header(raw)
    pcm = bytes(range(192)) * 3 + tail
    head = np.frombuffer(raw[meta["at"] :][:2] + bytes([0x60 | raw[meta["at"] + 2] & 15, raw[meta["at"] + 3], 3, n - 1]) + bytes(6), np.uint8)[None]
    frame = head[0, :6].tobytes() + bytes([int(media.crc8(head, np.array([6]))[0]), 2]) + bytes((x - 128) & 255 for x in tail)
    frame += int(media.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    word = int.from_bytes(raw[18:26], "big") - meta["samples"] + len(pcm)
    md5 = hashlib.md5(bytes((x - 128) & 255 for x in pcm)).digest()
    stream = raw[:18] + word.to_bytes(8, "big") + md5 + raw[42:] + frame
    _, samples, _ = media.decode([stream])[0]
    assert b"".join((row + 128).astype(np.uint8).tobytes() for row in samples) == pcm and [len(row) for row in samples] == [192, 192, 192, n]


def test_warc_query(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "http://c\r\nX: y", "Ü" * 3000), (7, "u", None), (9, "u", ""), (4, "v", "alone")]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, key int").repartition(3)
    got = {r.page_id: r for r in warc.records(warc.archives(pages, 0)).filter("gap is null").collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        p = (html or "").encode()
        head = max(a for a, _, c in rows if (c or "") == (html or ""))
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == head else ("revisit", head))
    large = warc.records(warc.archives(pages, 5)).filter("record_type = 'revisit'").count()
    assert large == 0 and warc.records(warc.archives(pages.limit(0))).count() == 0


def test_warc_digest_is_of_what_was_read():
    raw = warc.record(1, "u", b"payload", gzip=False).replace(b"X-Payload-Length: 7", b"X-Payload-Length: 9")
    raw = b"\r\n".join(x for x in raw.split(b"\r\n") if not x.startswith((b"WARC-Payload-Digest", b"WARC-Block-Digest")))
    (_, _, _, fields, block), = warc.read(raw)
    assert warc._described(fields, block)[1:3] == (7, warc.digest(b"payload"))


def test_warc_members_longer_than_a_step():
    rng = np.random.default_rng(2)
    parts = [warc.record(k, "u", rng.integers(0, 256, n, np.uint8).tobytes()) for k, n in enumerate((1, 3 * warc.STEP, 10, warc.STEP, 200_000))]
    found = list(warc.read(b"".join(parts)))
    assert [x[0] for x in found] == ["record"] * 5 and [x[2] - x[1] for x in found] == [len(p) for p in parts]


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_salvage(gzip):
    parts = [warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 30, gzip=gzip) for k in range(6)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    raw = parts[0] + parts[1] + bytes(bad) + b"garbage" + parts[3] + parts[4][:-9] + parts[5]
    found = list(warc.read(raw))
    ids = [f["warc-target-uri"] for what, _, _, f, _ in found if what == "record"]
    assert ids == [f"http://x/{k}" for k in (0, 1, 3, 5)]
    ends = np.cumsum([0, *map(len, (parts[0], parts[1], bad, b"garbage", parts[3], parts[4][:-9], parts[5]))]).tolist()
    assert [(a, b) for what, a, b, _, _ in found if what == "gap"] == [(ends[2], ends[4]), (ends[5], ends[6])]
    whole = sorted((a, b) for _, a, b, _, _ in found)
    assert whole[0][0] == 0 and whole[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(whole, whole[1:], strict=False))


def test_warc_records_of_other_archives(spark):
    def plain(*lines, block=b"some text"):
        return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    own = warc.record(3, "http://x/3", b"payload", gzip=False)
    parts = [plain("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>"), own, plain("WARC-Type: request"), plain("WARC-Type: request", "WARC-Record-ID: <urn:uuid:2>"), own.replace(b"page:3>", b"page:x>"), own.lower().replace(b"warc/", b"WARC/"), plain("WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:3>", "X-Payload-Length: many"), own]
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    got = sorted(warc.records(spark.createDataFrame([(1, bytearray(b"".join(parts)))], "archive long, data binary")).collect(), key=lambda r: r.start)
    said = base64.b32encode(hashlib.sha1(b"some text").digest()).decode()
    assert [(r.record_type, r.page_id, r.payload_bytes, r.payload_digest) for r in got if r.record_type in ("warcinfo", "request")] == [("warcinfo", None, 9, said), ("request", None, 9, said)]
    assert [r.page_id for r in got if r.record_type == "response"] == [3, 3]
    gaps = [(r.start, r.stop) for r in got if r.gap]
    assert (ends[2], ends[3]) in gaps and (ends[4], ends[7]) in gaps and len(gaps) == 2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(pii.digits(m[0])) <= 15]
    return sorted(out)


def test_pii_patterns_against_plain_expressions():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@z-1.example.com", "@", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (709) 555-6652", "+49", "++1 23", "é@a.b", "a..b@c..d", " ", "\n", "5", ".", "-", "+"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_network_gradients_and_held_out_accuracy():
    p = pii.initial(np.random.default_rng(0))
    x, y = pii.sample(random.Random(1), 3)
    x, y = x[:10], y[:10]
    loss, g = pii.loss_and_gradients(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), p[k].shape)
        q = {a: b.copy() for a, b in p.items()}
        q[k][at] += 1e-5
        assert abs((pii.loss_and_gradients(q, x, y)[0] - loss) / 1e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
    rng, hit, extra, missed = random.Random(77), 0, 0, 0
    said = [pii.labelled(rng) for _ in range(250)]
    for (_, want), (_, got) in zip(said, pii.all_spans([t for t, _ in said], pii.trained()), strict=True):
        hit, extra, missed = hit + len(set(want) & set(got)), extra + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert hit / (hit + missed) > 0.93 and hit / (hit + extra) > 0.95


def test_pii_query_and_redaction(spark):
    texts = ["write to a.b@c.org or (345) 555-3341 now", None, "", "clean words 3.0 only", "é 10.0.0.1, 10.0.0.1", "4111 1111 1111 1111" + " x" * 5000]
    docs = spark.createDataFrame([(k, t, len(t or ""), "s") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[0].spans == "email:9:18,phone:22:36" and got[0].n_email == 1 and got[0].n_phone == 0
    assert got[0].base_sha256 == hashlib.sha256(b"email:9:18").hexdigest()
    assert got[1].spans == got[2].spans == got[3].spans == "" and got[4].spans == "ip:2:10,ip:12:20" and got[5].spans == "card:0:19"
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[0].text == "write to <email> or <phone> now" and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text is None and clean[3].text == texts[3] and clean[4].text == "é <ip>, <ip>"


def test_license_scan(spark):
    texts = [
        "intro\nLicensed under CC BY-NC 4.0.\nmore", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "he took a license to fish and a copyright on songs", None, "", "x " * 3000 + "Licensed under the Apache License, Version 2.0." + " y" * 3000, "Released under the MIT License.\nnothing\nReleased under the MIT License.", "Licensed under the Apache License, Version 1.1.",
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    got = collections.defaultdict(list)
    for r in license_scan.scan(docs).collect():
        got[r.doc_id].append(r)
        assert texts[r.doc_id][r.start : r.stop].strip()
    assert {k: [r.license for r in v] for k, v in got.items()} == {0: ["CC-BY-NC-4.0"], 1: ["CC-BY-4.0"], 2: ["GPL-3.0"], 3: ["GPL-2.0"], 8: ["MIT", "MIT"], 7: ["Apache-2.0"]}


PROSE = "you can use it as you wish and modify it with or without changes, provided that the following steps are met. any person who has a copy of this software and the documentation files may deal in them without restriction, as published by the foundation. this work is subject to the terms of the form, and the author has no related or neighboring rights to it under law, to the extent that is possible. "


@pytest.mark.parametrize(("sentence", "license"), [("Licensed under the MIT License.", "MIT"), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")])
def test_license_in_long_prose(spark, sentence, license):
    docs = spark.createDataFrame([(1, PROSE + sentence + " " + PROSE)], "doc_id long, text string")
    assert [r.license for r in license_scan.scan(docs).collect()] == [license]


def test_each_license_of_a_line(spark):
    both = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    gpl = license_scan.TEMPLATES["GPL-3.0"][1]
    # a long line: licensing words before, and a statement over the end of what they reach
    texts = [both, both * 2, *("license " + "x " * n + gpl + " y" * 500 for n in range(20, 120, 7)), "x " * 300 + gpl + " " + "license " * 300 + gpl + " Licensed under CC BY 4.0."]
    got = collections.defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.license, texts[r.doc_id][r.start : r.stop]))
    mit, apache = (x.strip(" .") for x in (both[:31], both[31:]))
    assert got[0] == [("MIT", mit), ("Apache-2.0", apache)] and got[1] == got[0] * 2
    assert all(got[k] == [("GPL-3.0", gpl[:-1])] for k in range(2, len(texts) - 1))
    assert [x for x, _ in got[len(texts) - 1]] == ["GPL-3.0", "GPL-3.0", "CC-BY-4.0"]
    lesser = gpl.replace("GNU General", "GNU Lesser General")
    assert license_scan.judge_block(lesser, next(license_scan.blocks(lesser))) == []


@pytest.mark.parametrize("mark", ["", "# ", " * ", "//    ", "C "])
def test_wrapped_licenses(spark, mark):
    wordings = [(name, t) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    texts = ["intro\n\n" + "\n".join(mark + line for line in textwrap.wrap(t, 60)) + "\n\nint main()" for _, t in wordings]
    got = collections.defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id].append(r.license)
        assert r.bytes_saved > 0 and r.n_lacking + r.n_extra <= (mark == "C ") * texts[r.doc_id].count("\n")  # a mark a line
    # a letter as comment mark counts as a word more, which the shortest wordings may not have
    assert {k: v for k, v in got.items()} == {k: [name] for k, (name, t) in enumerate(wordings) if mark != "C " or k in got} and len(got) >= len(texts) - 3 * (mark == "C ")


def test_license_recall_on_edited_wrapped_and_dual_notices(spark):
    rng = random.Random(12)
    wordings = [(name, t) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    planted = []
    for _ in range(120):
        picked, parts = rng.sample(wordings, rng.randint(1, 2)), []
        for _, t in picked:
            w = t.split()
            free = [k for k, x in enumerate(w) if len(license_scan.words(x)) == 1 and not (set(license_scan.words(x)) & license_scan._CODES) and not any(c.isdigit() for c in x)]
            for k in rng.sample(free, int(0.1 * len(w))):  # a replaced word lacks and stands in its place
                w[k] = rng.choice(["thing", ""])
            parts.append("\n".join("# " + line for line in textwrap.wrap(" ".join(w), rng.randint(30, 90))))
        planted.append(({n for n, _ in picked}, PROSE + "\n" + ("\n#\n# " + PROSE + "\n").join(parts) + "\n" + PROSE))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(planted)] + [(1000 + k, PROSE * k) for k in range(1, 8)], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in license_scan.scan(docs).collect():
        got[r.doc_id].add(r.license)
    caught, all_of = sum(len(want & got[k]) for k, (want, _) in enumerate(planted)), sum(len(want) for want, _ in planted)
    wrong = sum(len(got[k] - want) for k, (want, _) in enumerate(planted)) + sum(len(v) for k, v in got.items() if k >= 1000)
    print(caught, all_of, wrong)
    assert caught >= 0.9 * all_of and wrong <= 0.03 * all_of


def test_license_defined_cases(spark):
    said = "Licensed under the MIT License."
    docs = spark.createDataFrame([(None, said), (1, said), (1, said), (2, None), (3, ""), (4, "word " * 400_000 + said)], "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == {None: 1, 1: 2, 4: 1} and {r.license for r in rows} == {"MIT"}
    assert next(r.start for r in rows if r.doc_id == 4) == 2_000_000
    assert license_scan.scan(docs.limit(0)).count() == 0


def least_differences(template, said):
    """By brute force over all stretches."""
    most, best = int(license_scan.MISSING * len(template)), None
    for a in range(len(said)):
        for b in range(a + 1, len(said) + 1):
            part = said[a:b]
            row = list(range(len(part) + 1))
            for i, x in enumerate(template):
                above, row = row, [i + 1]
                for j, y in enumerate(part):
                    row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
            cost = row[-1]
            if cost <= most and (best is None or cost < best):
                best = cost
    return best


@pytest.mark.parametrize("seed", range(6))
def test_license_places_against_brute_force(seed):
    rng = random.Random(seed)
    template = [rng.choice("abcdefgh") + "x" for _ in range(14)]
    for _ in range(20):
        said = [rng.choice("abcdefgh") + "x" for _ in range(6)] + template + [rng.choice("abcdefgh") + "x" for _ in range(6)]
        for _ in range(rng.randrange(4)):
            said[rng.randrange(len(said))] = "other"
            del said[rng.randrange(len(said))]
        found = license_scan.places(template, said)
        assert (found[0][0] if found else None) == least_differences(template, said)


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://EXAMPLE.com/en/7?x", "ftp://x.net/de/1", "http://example.net/de/8#t", "http://q.org/es/", "http://q.org/fr/", "http://q.org/es/2", "nourl", None, "http://notcom/en/", "://h/p", "http://com/en/", "http://z.info/en/x?y://b.org/es/", "http://sample.com", "http://a.b.org?es/"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == 2 * len(urls)
    say = lambda k: (got[k].host, got[k].path, got[k].rule, got[k].verdict)
    assert say(0) == ("a.example.com", "/en/1", "com/en/", "block") and say(1) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert say(2) == ("x.net", "/de/1", "net/de/", "allow") and say(3) == ("example.net", "/de/8", "example.net/de/8", "block")
    assert say(5) == ("q.org", "/fr/", None, "block")  # two thirds of this host's pages are blocked
    assert say(7) == say(8) == ("", "", None, "allow") and say(9)[3] == "allow" and say(12) == ("z.info", "/en/x", None, "allow")
    assert say(14) == ("a.b.org", "", None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS", 3)  # many wrong passes, so many levels
    universe = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed")).cache()
    cascade = url_filter.Cascade(universe)
    assert len(cascade.levels) > 3
    assert universe.filter(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.Cascade(universe.filter("not listed")).levels == []
    monkeypatch.setattr(url_filter, "MOST_BITS", 64)  # sharded, judged in blocks
    pages = spark.createDataFrame([(k, f"http://h{k % 40}.org/{'es' if k % 3 else 'x'}/") for k in range(400)], "page_id long, url string")
    many = sorted(map(tuple, url_filter.judge(pages).collect()))
    monkeypatch.setattr(url_filter, "MOST_BITS", 1 << 26)
    assert many == sorted(map(tuple, url_filter.judge(pages).collect()))
