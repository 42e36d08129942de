"""Fill-in-middle, the conversation prefix trie and WARC in ZIP against plain versions, with every edge case on small tables."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest

pytest.importorskip("glossaria.llm")
from glossaria.llm import zip_warc
from glossaria.llm.fill_in_middle import Checkpoints, FillInMiddle, restored
from glossaria.llm.prefix_trie import PrefixTrie
from glossaria.llm.zip_warc import Package, ZipWarc, discard, parse_record, write_package

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")

# ------------------------------------------------------------------ fill in middle


def spaced(rng, n):
    return "".join(rng.choice(["a", "é", "日本", " ", "\n", "\t\x0b ", "<", "P>", "\xa0", "x" * rng.randint(1, 9)]) for _ in range(n))


@pytest.mark.parametrize("every,piece", [(1, 1), (2, 3), (3, 64), (256, 1 << 16)])
def test_checkpoints_equal_offsets_of_all_units(every, piece):
    rng = random.Random(every * 100 + piece)
    for n in (0, 1, 2, 7, 60, 300):
        text = spaced(rng, n)
        ends = [m.end() for m in UNIT.finditer(text)]
        index = Checkpoints(np.frombuffer(text.encode(), np.uint8), every, piece)
        assert (index.units, index.points) == (len(ends), len(text))
        assert len(index.bytes) == len(ends) // every + 1  # no more than the checkpoints is stored
        for k in range(len(ends) + 1):
            chars = ends[k - 1] if k else 0
            assert index.cut(k, step=piece) == (len(text[:chars].encode()), chars)


def plain_fim(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    u = [m[0] for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def test_fill_in_middle_equals_plain_version_and_restores(spark):
    rng = random.Random(3)
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "a <P> b"), (6, "<S"), (7, "x" * 300_000), (8, "日 " * 120_000), (8, "日 " * 120_000)]
    rows += [(10 + k, spaced(rng, rng.randint(0, 400))) for k in range(300)]
    df = spark.createDataFrame([(i, x, 1, "f", 2) for i, x in rows], "doc_id long, text string, n int, form string, output int")
    for rate, spm in ((50, 80), (100, 50), (0, 100)):
        got = FillInMiddle(rate, spm, every=16).transform(df)
        got = got.withColumn("back", restored("output", "form")).collect()
        want = [(i, *plain_fim(i, x, rate, spm), x or "") for i, x in rows]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert FillInMiddle().transform(df.limit(0)).collect() == []


# ------------------------------------------------------------------ prefix trie


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, tie), role, text))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    trunc = lambda c: c - int(np.fmod(c, 20))
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(convs.get(trunc(c), [])[:h]) + tuple(own[h:])
    nodes = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    out = []
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids.get(k, 0), sum(not kids.get(x) for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONVS = "conv_id long, turn int, role string, text string, depth int, words string, k1 string, d string"


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "w", "k", "d") for r in rows], CONVS)
    return sorted((tuple(r) for r in PrefixTrie(**kw).nodes(df).collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-45, 130), rng.randint(0, 40), 10**12 + rng.randint(0, 30)])
        length = rng.choice([1, 2, 3, 4, rng.randint(1, longest)])
        for t in range(length):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a", "a b", " x  y z ", "a b"])))
    rows += [(None, 0, "user", "nobody")] * 2
    return rows + rows[:5]


@pytest.mark.parametrize("seed,kw,longest", [(1, {}, 9), (2, {"whole": 4, "block": 2}, 30), (3, {"whole": 5, "block": 3}, 60)])
def test_trie_equals_plain_version(spark, seed, kw, longest):
    rows = conversations(seed, 60, longest)
    assert trie(spark, rows, **kw) == plain_trie(rows)


def test_trie_of_one_hot_conversation_and_many_copies(spark):
    long_ = [(40, t, "user", f"t{t % 3}") for t in range(90)]
    copies = [(1000 + 20 * k, t, "user", f"t{t % 3}") for k in range(60) for t in range(6)]
    rows = long_ + copies + [(41, t, "user", f"t{t % 3}") for t in range(70)]
    got = trie(spark, rows, whole=8, block=4)
    assert got == plain_trie(rows)
    deep = [(20 * k, t, "user", "same" if t < k else f"own{k}") for k in range(14) for t in range(16)]  # chains hang on chains
    assert trie(spark, deep) == plain_trie(deep)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


# ------------------------------------------------------------------ WARC in ZIP


class Bytes:
    """A file in memory that counts what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, length, offset):
        self.read += length
        return self.data[offset : offset + length]


def sample_records(n=5):
    for i in range(n):
        body = f"<p>{i}</p>".encode() * (i * 50)
        yield (
            {"url": f"http://x/{i}", "date": "2000", "type": "response", "digest": zip_warc.digest_of(body)},
            zip_warc.page_record(i, f"http://x/{i}", zip_warc.digest_of(body), len(body), body, f"urn:uuid:{i}", None, "2000-01-01T00:00:00Z"),
        )


def test_package_directory_agrees_with_the_library(monkeypatch):
    out = io.BytesIO()
    assert write_package(out, sample_records(), 1 << 20) == 5
    data = out.getvalue()
    p = Package(Bytes(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert set(p.members) == set(z.namelist())
        for name in z.namelist():
            at, n = p.data(name)
            assert data[at : at + n] == z.read(name)
    found = [parse_record(data[at : at + n]) for at, n in p.ranges()]
    assert [f["page-id"] for f, _ in found] == list("01234")
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == [f"<p>{i}</p>".encode() * (i * 50) for i in range(5)]


def test_zip64_directories(monkeypatch):
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", "x" * 100)
        z.writestr("archive/data.warc.gz", b"".join(zlib.compress(w, wbits=31) for _, w in sample_records(3)))
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z:
        z.comment = b"PK\x05\x06 a note that looks like an end"
        z.writestr("a.txt", "x" * 100)
        z.writestr("archive/data.warc.gz", b"".join(zlib.compress(w, wbits=31) for _, w in sample_records(3)))
    assert struct.pack("<I", zip_warc.END64) in wide.getvalue() and struct.pack("<I", zip_warc.END64) not in plain.getvalue()
    for raw in (plain.getvalue(), wide.getvalue()):
        p = Package(Bytes(raw))
        assert raw[p.data("a.txt")[0] :][:100] == b"x" * 100
        # No index: the archive is walked record by record.
        assert [parse_record(raw[at : at + n])[0]["page-id"] for at, n in p.ranges()] == list("012")


def test_package_is_read_by_ranges_and_refuses_what_it_cannot():
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        z.writestr("ballast.bin", b"\0" * 5_000_000)
        z.writestr("archive/one.warc", b"".join(w for _, w in sample_records(2)))
        z.writestr("archive/two.warc.gz", b"".join(zlib.compress(w, wbits=31) for _, w in sample_records(3)))
    file = Bytes(big.getvalue())
    ranges = list(Package(file).ranges())
    assert [parse_record(file.data[at : at + n])[0]["page-id"] for at, n in ranges] == list("01012")
    assert file.read < 400_000  # the ballast is never read
    for bad in (b"", b"no zip", big.getvalue()[:-30]):
        with pytest.raises(ValueError):
            Package(Bytes(bad))
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/one.warc", b"".join(w for _, w in sample_records(2)))
    with pytest.raises(ValueError, match="deflated"):
        list(Package(Bytes(deflated.getvalue())).ranges())
    cut = io.BytesIO()
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("archive/two.warc.gz", zlib.compress(next(iter(sample_records(1)))[1], wbits=31)[:-9])
    with pytest.raises(ValueError, match="ends within"):
        list(Package(Bytes(cut.getvalue())).ranges())


def plain_records(pages, least=0):
    groups = {}
    for k, (page, url, text) in enumerate(pages):
        groups.setdefault((text or "").encode(), []).append(((page is not None, page or 0, url is not None, url or ""), k))
    out = []
    for payload, rows in groups.items():
        best = max(rows)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for _, k in rows:
            first = k == best[1] or len(payload) < least
            out.append((pages[k][0], len(payload), digest, "response" if first else "revisit", None if first else pages[best[1]][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,package", [(0, 64 << 20), (5, 4000)])
def test_warc_round_trip_equals_plain_version(spark, least, package):
    rng = random.Random(package)
    texts = ["", None, "a", "<p>é日本</p>", "x" * 200_000, "\r\n\r\nWARC/1.1\r\n\r\n", "same"] + [f"page {k}" for k in range(40)]
    pages = [(k, f"http://h/{k}?q=a b\r\nX: 1", rng.choice(texts)) for k in range(120)]
    pages += [(None, None, "same"), (None, "u", "same"), (7, "u", "same"), (7, "u", "same"), (500, "u", "same"), (500, "u", "same"), (500, None, "same"), (501, None, "only"), (501, None, "only")]
    pages += [(900, "http://日本/", "hot")] * 300
    df = spark.createDataFrame([(*p, 1, "x", "y") for p in pages], "page_id long, url string, html string, bytes int, digest string, path string").repartition(3)
    warc = ZipWarc(least=least, package=package)
    manifest = warc.write(df)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    got = warc.resolved(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_records(pages, least)
    whole = {r["digest"]: bytes(r["payload"]) for r in warc.records(manifest).where("type = 'response'").collect()}
    assert set(whole.values()) == {(t or "").encode() for _, _, t in pages}
    names = [r["record_id"] for r in warc.records(manifest, payloads=False).collect()]
    assert len(names) == len(set(names)) == len(pages)
    discard(spark, manifest)


def test_warc_of_no_pages(spark):
    warc = ZipWarc()
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.collect() == [] and warc.resolved(manifest).collect() == []
