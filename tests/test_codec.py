"""Round trips of synthetic files, indexes and odd records."""

import random
import struct

import pytest

from readloom.codec import bam, bgzf, index, tags, writer
from readloom.codec.index import Chunk

REFS = [("chr1", 500_000), ("empty", 1000), ("chr2", 500_000)]
TEXT = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:500000\n"


def some_rows(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        span = rng.randint(1, 300)
        seq = "".join(rng.choice("ACGTN=") for _ in range(rng.choice([0, span, span])))
        rows.append({
            "ref_id": rng.choice([0, 0, 2]), "start": rng.randrange(400_000), "name": f"r{i // 2}", "flags": rng.randrange(4096), "mq": rng.choice([255, 0, 60]),
            "cigar": [span << 4, 3 << 4 | 6, rng.randint(0, 20) << 4 | 2], "seq": seq, "qual": bytes(i % 40 for _ in seq) if seq else None,
            "next_refid": -1, "next_pos": -1, "template_length": -i, "tags": [("NM", "C", i % 200), ("ZZ", "Z", "é" * (i % 3)), ("XB", "Bs", [-1, i % 99])],
        })
    rows.sort(key=lambda r: (r["ref_id"], r["start"]))
    return rows + [{"name": "lost", "flags": 4}, {"name": "lost", "flags": 4}]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("bam") / "a.bam"), some_rows()
    places = writer.write_bam(path, TEXT, REFS, rows, block=300)
    import os

    end = os.path.getsize(path) - 28 << 16
    for kind in ("bai", "csi"):
        with open(f"{path}.{kind}", "wb") as f:
            f.write(writer.index_bytes([p for p in places if p[0] >= 0], len(REFS), end, kind))
    return path, rows


def span(r):
    return 0 if r["flags"] & 4 else sum(w >> 4 for w in r.get("cigar", []) if 0x18D >> (w & 15) & 1)


def read_all(path, window=1 << 20, begin=None, stop=None):
    s = bgzf.Source(path)
    h = bam.read_header(s)
    out = []
    for buf, starts, ids in bam.records(s, h.first_record if begin is None else begin, stop, window):
        out += bam.batch(buf, starts, ids, [n for n, _ in h.references]).to_pylist()
    return out


@pytest.mark.parametrize("window", [1, 100_001, 1 << 20])
def test_stream_equals_what_was_written(made, window):
    path, rows = made
    got = read_all(path, window)
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    assert [r["record_id"] for r in got] == sorted(r["record_id"] for r in got)
    for a, b in zip(got, rows):
        assert (a["name"], a["flags"], a["ref_id"], a["start"]) == (b["name"], b["flags"], b.get("ref_id", -1), b.get("start", -1))
        assert a["mq"] == (None if b.get("mq", 255) == 255 else b["mq"])
        assert a["cigar"] == b.get("cigar", []) and a["length_on_ref"] == span(b) and a["end"] == a["start"] + span(b)
        assert a["qual"] == b.get("qual") and a["seq_packed"] == writer.pack_bases(b.get("seq", ""))
        if "tags" in b:
            t = tags.decode(a["tags_raw"])
            assert t["NM"]["i"] == b["tags"][0][2] and t["ZZ"]["s"] == b["tags"][1][2] and t["XB"]["ai"] == b["tags"][2][2]


@pytest.mark.parametrize("kind", ["bai", "csi"])
def test_chunks_hold_what_overlaps_and_each_record_once(made, kind):
    path, rows = made
    found = index.parse(bgzf.Source(f"{path}.{kind}").all())
    rng = random.Random(4)
    sample = rng.sample([r for r in rows if "start" in r and r["ref_id"] >= 0], 12)
    windows = [(r["ref_id"], a, b) for r in sample for a, b in ((r["start"] + span(r) - 1, r["start"] + 900), (r["start"] + span(r), r["start"] + 900), (r["start"] - 900, r["start"] + 1), (r["start"] - 900, r["start"]))]
    for ref, a, b in [*windows, (0, 0, 1 << 40), (2, 399_000, 1 << 31), (1, 0, 1000), (0, 900_000, 1_000_000)]:
        a, b = max(0, a), max(b, a, 0)
        ids, got = set(), 0
        for c in found.chunks(ref, a - 1, b):
            for r in read_all(path, begin=c.begin, stop=c.stop):
                assert r["record_id"] not in ids
                ids.add(r["record_id"])
                got += r["ref_id"] == ref and r["start"] < b and max(r["end"], r["start"] + 1) > a
        assert got == sum(r.get("ref_id", -1) == ref and r["start"] < b and max(r["start"] + span(r), r["start"] + 1) > a for r in rows)


def test_index_counts(made):
    path, rows = made
    for kind in ("bai", "csi"):
        found = index.parse(bgzf.Source(f"{path}.{kind}").all())
        assert [found.line_count(i) for i in (0, 1, 2, 9, None)] == [sum(r.get("ref_id") == i and not r["flags"] & 4 for r in rows) for i in (0, 1, 2)] + [0, 0]
        assert found.has_ref(1) and not found.has_ref(3)
        assert 0 < found.forecast([(0, 0, 1000)]) <= found.forecast([(0, 0, 1 << 29), (2, 0, 1 << 29)])
    bai = index.parse(bgzf.Source(path + ".bai").all())
    assert bai.density(0)[0][:2] == (0, 16384) and len(bai.density(0, 20_000, 40_000)) == 2 and bai.density(0, 10**7) == []
    assert index.parse(bgzf.Source(path + ".csi").all()).density(0) == []


def test_long_cigar(tmp_path):
    real = writer.cigar_words("1M1D3M")
    base = {"ref_id": 0, "start": 5, "flags": 0, "cigar": writer.cigar_words("4S90N"), "seq": "ACGT", "qual": b"1234"}
    rows = [{**base, "tags": [("CG", "BI", real)]}, {**base, "tags": [("CG", "Bi", real)]}, base, {**base, "tags": [("CG", "Z", "no")]}]
    path = str(tmp_path / "cg.bam")
    writer.write_bam(path, TEXT, REFS, rows)
    got = read_all(path)
    assert [r["cigar"] for r in got] == [real, real, [], []]
    assert all(r["end"] == 95 and r["cigar_from_cg"] and r["num_cigar_ops"] == 2 for r in got)


def test_tags():
    raw = b"".join(tags.encode(*t) for t in [("AA", "A", "x"), ("BB", "f", 1.5), ("CC", "H", "1AE3"), ("DD", "Bf", [0.5]), ("EE", "I", 4_000_000_000), ("AA", "c", -1), ("FF", "s", -300)])
    t = tags.decode(raw + b"GG?whatever")
    assert t["AA"]["s"] == "x" and t["BB"]["f"] == 1.5 and t["CC"]["s"] == "1AE3" and t["DD"]["af"] == [0.5] and t["EE"]["i"] == 4_000_000_000 and t["FF"]["i"] == -300
    assert "GG" not in t and tags.find(raw, "AA") == ("A", "x") and tags.find(raw, "ZZ") is None
    assert tags.find_raw(raw, "CC") == b"1AE3" and tags.decode(None) == {}


def test_cut_files(made, tmp_path):
    path, _ = made
    with open(path, "rb") as f:
        data = f.read()

    def put(part):
        p = str(tmp_path / "cut.bam")
        with open(p, "wb") as f:
            f.write(part)
        return p

    with pytest.raises(bgzf.Truncated, match="inside a BGZF block"):
        read_all(put(data[:-40]))
    with pytest.raises(bgzf.Truncated, match="header"):
        bam.read_header(bgzf.Source(put(bgzf.deflate(b"BAM\1" + struct.pack("<i", 100)))))
    with pytest.raises(ValueError, match="not BGZF"):
        bam.read_header(bgzf.Source(put(b"plain text, nothing else, long enough")))
    with pytest.raises(ValueError, match="not a BAM"):
        bam.read_header(bgzf.Source(put(bgzf.deflate(b"other contents"))))
    blocks = list(bgzf.blocks(bgzf.Source(path)))
    with pytest.raises(bgzf.Truncated, match="inside a record"):
        read_all(put(data[: blocks[len(blocks) // 2][0]] + bgzf.EOF_BLOCK))


def v(block, inside=0):
    return block << 16 | inside


def test_reads_are_joined_by_gap_and_span():
    plan = lambda cs, floor=None: [(c.begin, c.stop) for c in index.disjoint(index.join(cs, floor))]
    near, far = index.GAP - 1, index.GAP
    a = Chunk(v(700, 9), v(900, 3))
    assert plan([Chunk(v(900 + near), v(70_000)), a]) == [(a.begin, v(70_000))]
    assert plan([Chunk(v(900 + far), v(70_000)), a]) == [(a.begin, a.stop), (v(900 + far), v(70_000))]
    assert plan([a, Chunk(v(800), v(700 + index.SPAN - 1))]) == [(a.begin, v(700 + index.SPAN - 1))]
    # too long together: the second begins where the first ends
    assert plan([a, Chunk(v(800), v(700 + index.SPAN))]) == [(a.begin, a.stop), (a.stop, v(700 + index.SPAN))]
    assert plan([a, Chunk(v(750), v(800))]) == [(a.begin, a.stop)]  # one inside the other
    assert plan([a, Chunk(v(2000), v(3000))], a.stop) == [(v(2000), v(3000))] and plan([a], a.stop - 1) == [(a.begin, a.stop)]
    assert plan([Chunk(v(8), v(8))]) == [(v(8), v(8))] and plan([]) == []


def test_reads_end_at_known_blocks():
    first, second = Chunk(v(40), v(300, 7)), Chunk(v(90_000), v(91_000, 5))
    a, b = index.tighten([first, second], [])
    assert (a.end_position, b.end_position, b.fetched_size()) == (300 + index.TAIL, 91_000 + index.TAIL, 1000 + index.TAIL)
    a, b = index.tighten([first, second], [300, 301, 91_400, 99_000])
    assert (a.end_position, a.fetched_size(), b.end_position) == (301, 261, 91_400)
    assert index.tighten([Chunk(v(40), v(300), end_position=310)], [600])[0].end_position == 310


def test_forecasts_take_what_lies_before_a_bound():
    cs = [Chunk(v(70 * i + 5), v(70 * i + 60)) for i in range(15)]
    assert [len(index.likely(cs, bound)) for bound in (6, 70 * 8 + 5, 70 * 8 + 6, 10**9)] == [index.FORECAST_FLOOR, 8, 9, 15]
    assert index.likely(cs, 5) == index.likely(cs, None) == cs


def test_stored_blocks_have_known_sizes(tmp_path):
    for n in (0, 1, 60_000, 65_000):
        block = bgzf.deflate(bytes(n), 0)
        assert len(block) == n + bgzf.STORED and bgzf.inflate_all(block) == bytes(n)
    rows = some_rows(300)
    places = writer.write_bam(str(tmp_path / "s.bam"), TEXT, REFS, rows, block=500, level=0)
    assert [r["name"] for r in read_all(str(tmp_path / "s.bam"))] == [r["name"] for r in rows]
    at = len(writer.head_bytes(TEXT, REFS)) + bgzf.STORED
    sizes = [len(writer.encode_record(r)) for r in rows]
    before = [sum(sizes[:i]) for i in range(len(rows))]
    assert [p[3] for p in places] == [(at + p // 500 * (500 + bgzf.STORED)) << 16 | p % 500 for p in before]


@pytest.mark.parametrize("block,level,spans", [(300, 6, 300), (60_000, 0, 300), (700, 0, 4000)])
def test_records_are_found_from_any_byte(tmp_path, block, level, spans):
    """Also where records are longer than blocks, and contents hold the magic bytes."""
    rng = random.Random(block)
    rows = some_rows(400, seed=block)
    for r in rows[:-2]:
        n = rng.randint(1, spans)
        r |= {"cigar": [n << 4], "seq": "A" * n, "qual": (bgzf.MAGIC * n)[:n] if rng.random() < 0.3 else bytes(n)}
    path = str(tmp_path / "any.bam")
    places = [p[3] for p in writer.write_bam(path, TEXT, REFS, rows, block=block, level=level)]
    source = bgzf.Source(path)
    starts = [at for at, _ in bgzf.blocks(source)]
    for byte in [0, *rng.sample(range(source.size()), 60), source.size() - 40, source.size() - 28, source.size()]:
        at = next((b for b in starts if b >= byte), None)
        assert bgzf.block_from(source, byte) == at
        want = next((p for p in places if at is not None and p >> 16 >= at), None)
        assert byte == 0 or bam.record_from(source, byte, len(REFS)) == want


def test_fields_on_request(made):
    path, _ = made
    s = bgzf.Source(path)
    h = bam.read_header(s)
    names = ["flag_nc", "num_cigar_bytes", "num_seq_bytes", "seq_start", "tags_start", "raw", "flags", "num_cigar_ops", "seq_packed", "tags_raw", "cigar"]
    buf, starts, ids = next(bam.records(s, h.first_record, None))
    for r in bam.batch(buf, starts, ids, [], names).to_pylist():
        assert r["flag_nc"] == r["flags"] << 16 | r["num_cigar_ops"] and r["num_cigar_bytes"] == 4 * len(r["cigar"])
        assert len(r["seq_packed"]) == r["num_seq_bytes"] and r["raw"][r["seq_start"]:][:r["num_seq_bytes"]] == r["seq_packed"]
        assert r["raw"][r["tags_start"]:] == r["tags_raw"] and int.from_bytes(r["raw"][:4], "little") == len(r["raw"]) - 4
    assert not set(bam.ON_REQUEST) & set(bam.batch(buf, starts, ids, []).schema.names)


def test_first_data_and_ceiling(made):
    path, rows = made
    bai = index.parse(bgzf.Source(path + ".bai").all())
    assert bai.first_data() == bam.read_header(bgzf.Source(path)).first_record
    assert index.Index("bai", [index.RefIndex({1: [Chunk(0, 5)]}, [0])]).first_data() is None
    assert bai.ceiling(0, 0) == bai.refs[0].linear[1] >> 16 and bai.ceiling(0, 1 << 29) is None
    assert index.parse(bgzf.Source(path + ".csi").all()).ceiling(0, 0) is None
    assert index.unpack_offset(v(77, 12)) == (77, 12) and Chunk(v(7, 1), v(8, 2)).key() == "7:1-8:2"


def test_bins():
    assert index.bin_ranges(0, 1) == [(0, 0), (1, 1), (9, 9), (73, 73), (585, 585), (4681, 4681)]
    assert index.bin_ranges(0, 1 << 40)[-1] == (4681, 37448)
    assert index.bin_ranges(1 << 31, 1 << 32, kind="csi") == []
    with pytest.raises(ValueError, match="too many bins"):
        index.bin_ranges(0, 1 << 50, 14, 12, "csi")
    with pytest.raises(ValueError, match="please use CSI"):
        index.parse(b"BAI\1" + struct.pack("<iiIi", 1, 1, 40_000, 0))


def test_header_lines():
    got = bam.parse_header_text("@HD\tVN:1.6\n\n@SQ\tSN:a:b\tLN:3\n@CO\tno colon\n")
    assert got == [{"tag": "HD", "data": [{"tag": "VN", "value": "1.6"}]}, {"tag": "SQ", "data": [{"tag": "SN", "value": "a:b"}, {"tag": "LN", "value": "3"}]}, {"tag": "CO", "data": [{"tag": "no colon", "value": ""}]}]
    table = struct.pack("<i", 2) + b"".join(struct.pack("<i", 2) + b"a\0" + struct.pack("<i", n) for n in (5, 6))
    assert bam.parse_references(table, 0, lambda n: n + "!")[0] == [("a!", 5), ("a!", 6)]
    assert bam.parse_references(table[:-1], 0) is None
    assert bam.Header("", [("a", 5), ("a", 6)], 0).ids() == {"a": 1}


def test_tabix_details():
    aux = struct.pack("<7i", 0x10002, 1, 2, 0, 35, 0, 4) + b"a\0b\0"
    assert index.tabix_details(aux) == {"format": "VCF", "coordinates": "0-based", "columns": {"ref": 1, "start": 2, "end": 0}, "meta": "#", "skip_lines": 0, "names": ["a", "b"]}
    assert index.tabix_details(b"") is None
