"""Plans and pushdown of the sources, pairs, htsget replies."""

import base64
import http.server
import json
import os
import random
import shutil
import sys
import threading
import tracemalloc
from collections import Counter
from itertools import accumulate
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readloom import shared
from readloom.codec import bgzf, writer
from readloom.operators import pairs, reference, region
from readloom.plans import derive, queries
from readloom.plans.derive import bam_file
from readloom.sources import bam as source
from readloom.sources import htsget
sys.path.insert(0, str(Path(__file__).parent))
from test_codec import made, span  # noqa: F401


def test_region_option_filters_and_full_scan_agree(spark, made):  # noqa: F811
    path, rows = made
    whole = source.read_bam(spark, path, useIndex="false")
    for a, b in ((0, 1000), (123_456, 200_000), (399_000, 1 << 29), (5, 5)):
        want = {r.record_id for r in region.records_for_range(whole, "chr2", a, b).collect()}
        assert {r.record_id for r in source.read_bam(spark, path, region=f"chr2:{a}-{b}").collect()} == want
        for kind in ("bai", "csi"):
            assert {r.record_id for r in source.region_reads(spark, path, "chr2", a, b, index=f"{path}.{kind}").collect()} == want
            once = source.read_bam(spark, path, index=f"{path}.{kind}", pushdown="true")
            assert {r.record_id for r in region.records_for_range(once, "chr2", a, b).collect()} == want
    assert whole.count() == source.read_bam(spark, path, splitBytes="20000").count() == len(rows)
    assert source.read_bam(spark, path, splitBytes="20000").rdd.getNumPartitions() > 3
    for size in ("3000", "20000", "1000000000"):
        cut = source.read_bam(spark, path, useIndex="false", splitBytes=size)
        assert sorted(r.record_id for r in cut.select("record_id").collect()) == sorted(r.record_id for r in whole.select("record_id").collect())
        assert (cut.rdd.getNumPartitions() > 3) == (size != "1000000000")
    two = source.read_bam(spark, path, region="chr1:0-5000;chr1:4000-9000")
    assert two.count() == region.records_for_range(whole, "chr1", 0, 9000).count()


def test_unknown_names_and_columns(spark, made):  # noqa: F811
    path, _ = made
    assert source.read_bam(spark, path, region="none:0-10").count() == 0
    assert source.read_bam(spark, path, columns="start,flags").columns == ["start", "flags"]
    assert source.read_bam(spark, path, rename="chr1=1").where("ref_name = '1'").count() > 0
    assert source.estimated_bytes(path, [("none", 0, 10)]) == 0 and source.line_count(path, "none") == 0
    with pytest.raises(ValueError, match="start is after"):
        source.parse_region("chr1:9-3")
    with pytest.raises(ValueError, match="start is after"):
        region.records_for_range(spark.range(1), 0, 9, 3)


def test_pairs_across_references(spark):
    rows = [(1, "a", 0, 10, 60, 1, 500), (2, "a", 1, 500, 550, 0, 10), (3, "b", 0, 20, 70, 0, 30), (4, "b", 0, 30, 80, 0, 20), (5, "c", 0, 40, 90, 0, 9000), (6, "c", 0, 9000, 9050, 0, 40)]
    reads = spark.createDataFrame(rows, "record_id long, name string, ref_id int, start int, end int, next_refid int, next_pos int")
    got = lambda **k: {(r.record_id, r.is_mate) for r in pairs.view_as_pairs(reads, 0, 0, 100, **k).collect()}
    hits = {(1, False), (3, False), (4, False), (5, False)}
    assert got() == hits | {(6, True)}
    assert got(max_insert=100) == hits
    assert got(across=True) == hits | {(2, True), (6, True)}


def test_pairs_by_broadcast_and_by_shuffle_agree(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        places = [(rng.randrange(3), rng.randrange(3000)) for _ in range(2)]
        for k, (ref, start) in enumerate(places):
            other = places[1 - k]
            rows.append((2 * i + k, f"n{i // 2 if i % 7 == 0 else i}", ref, start, start + rng.randint(0, 90), other[0] if rng.random() < 0.95 else None, other[1]))
    reads = spark.createDataFrame(rows, "record_id long, name string, ref_id int, start int, end int, next_refid int, next_pos int")
    for across in (False, True):
        hits = [r for r in rows if r[2] == 1 and r[3] < 1500 and max(r[4], r[3] + 1) > 900]
        names = [r[1] for r in hits]
        asked = {(r[1], r[5], r[6]) for r in hits if names.count(r[1]) == 1 and (across or (r[5] == 1 and abs(r[3] - r[6]) < 700))}
        mates = {r[0] for r in rows for n, ref, pos in asked if r[1] == n and r[2] == ref and r[3] <= pos < max(r[4], r[3] + 1)} - {r[0] for r in hits}
        want = {(r[0], False) for r in hits} | {(m, True) for m in mates}
        assert mates
        for how in ({}, {"broadcast_rows": 0}, {"most_ranges": 0}):
            got = pairs.view_as_pairs(reads, 1, 900, 1500, across=across, max_insert=700, **how).collect()
            assert {(r.record_id, r.is_mate) for r in got} == want and len(got) == len(want)


def test_reference_binding_over_many_tiles(spark):
    rng = random.Random(3)
    seqs = [(r, a, "".join(rng.choice("ACGT") for _ in range(n))) for r, a, n in ((0, 3, 200), (0, 90, 300), (0, 90, 250), (1, 0, 64), (2, 5, 0))]
    rows = [(i, rng.randrange(3), a, a + rng.choice([0, 1, 7, 16, 17, 40, 150])) for i in range(300) for a in [rng.randrange(350)]]
    rows += [rows[0], (None, 0, 100, 180), (900, None, 1, 2), (901, 0, None, 5)]
    reads = spark.createDataFrame(rows, "id long, ref_id int, start int, end int")
    got = reference.bind_reference(reads, spark.createDataFrame(seqs, "ref_id int, start int, seq string"), shift=4)
    want = Counter()
    for i, ref, a, b in rows:
        found = [(s, q[a - s:b - s]) for r, s, q in seqs if q and a is not None and r == ref and s <= a and s + len(q) >= b]
        for s, q in found or [(None, None)]:
            want[i, s, None if s is None else a, q] += 1
    assert Counter((r.id, r.region_start, r.reference_start, r.reference_seq) for r in got.collect()) == want


def test_reference_binding(spark):
    reads = spark.createDataFrame([(1, 0, 5, 9), (2, 0, 5, 40), (3, 0, 18_000, 18_004), (4, 1, 5, 9), (5, 0, 100, 20_000)], "id long, ref_id int, start int, end int")
    seq = spark.createDataFrame([(0, 2, "ACGTACGTAC" * 3000)], "ref_id int, start int, seq string")
    got = {r.id: r.reference_seq for r in reference.bind_reference(reads, seq).collect()}
    whole = "ACGTACGTAC" * 3000
    assert got == {1: whole[3:7], 2: whole[3:38], 3: whole[17_998:18_002], 4: None, 5: whole[98:19_998]}
    spans = reference.needed_span(reads, F.col("id") == 2)
    assert {(r.ref_id, r.span_start, r.span_end) for r in spans.collect()} == {(0, 5, 20_000), (1, 5, 9)}
    assert reference.fetched(spans, lambda ref, a, b: "A" * (b - a) if ref else None).count() == 1


def ticket(*contents):
    urls = [{"url": "data:;base64," + base64.b64encode(c).decode()} for c in contents]
    return "data:application/json;base64," + base64.b64encode(json.dumps({"htsget": {"format": "BAM", "urls": urls}}).encode()).decode()


def test_htsget(spark, made):  # noqa: F811
    path, rows = made
    with open(path, "rb") as f:
        data = f.read()
    source.register(spark)
    ask = "referenceName=chr1&start=1000&end=50000&format=BAM"
    read = lambda reply, region: spark.read.format("htsget").option("replies", json.dumps({"https://h/x?class=header&format=BAM": ticket(data), f"https://h/x?{ask}": reply})).option("region", region).load("https://h/x")
    want = sum(r.get("ref_id") == 0 and r["start"] < 50_000 and max(r["start"] + span(r), r["start"] + 1) > 1000 for r in rows)
    assert read(ticket(data), "chr1:1000-50000").count() == want
    blocks = [at for at, _ in bgzf.blocks(bgzf.Source(path))]
    cut = blocks[len(blocks) // 2]
    assert read(ticket(data[:cut], data[cut:]), "chr1:1000-50000").count() == want
    assert read(ticket(data), "nowhere:0-5").count() == 0
    with pytest.raises(Exception, match="inside a"):
        read(ticket(data[: len(data) // 2]), "chr1:1000-50000").count()


class Server(http.server.BaseHTTPRequestHandler):
    """Tickets and their parts over HTTP; what was asked is noted."""

    asked: list = []
    data, cut = b"", 0

    def do_GET(self):  # noqa: N802
        base = f"http://127.0.0.1:{self.server.server_port}"
        type(self).asked.append((self.path, dict(self.headers)))
        if self.path.startswith("/part/"):
            body = self.data[:self.cut] if self.path.endswith("0") else self.data[self.cut:]
        elif "nobody" in self.path:
            self.send_response(404)
            self.end_headers()
            self.wfile.write(json.dumps({"htsget": {"error": "NotFound", "message": "x" * 600}}).encode())
            return
        else:
            urls = [{"url": f"{base}/part/{k}", "headers": {"Part-Key": str(k), "Referer": "https://no.example"}} for k in (0, 1)]
            body = json.dumps({"htsget": {"format": "BAM", "urls": urls}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_htsget_over_http(spark, made):  # noqa: F811
    path, rows = made
    Server.data = bgzf.Source(path).all()
    blocks = [at for at, _ in bgzf.blocks(bgzf.Source(path))]
    Server.cut = blocks[len(blocks) // 3]
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source.register(spark)
        base = f"http://127.0.0.1:{server.server_port}"
        read = lambda name, **o: spark.read.format("htsget").options(url=base, id=name, headers=json.dumps({"Authorization": "Bearer t", "referer": "no"}), **o).load()
        assert read("reads").count() == len(rows)  # without a region: everything
        want = sum(r.get("ref_id") == 2 and r["start"] < 90_000 and max(r["start"] + span(r), r["start"] + 1) > 500 for r in rows)
        assert read("reads", region="chr2:500-90000").count() == want
        asked = Server.asked
        assert any("referenceName=chr2&start=500&end=90000&format=BAM" in p for p, _ in asked)
        assert all(h.get("Authorization") == "Bearer t" and not any(k.lower() == "referer" for k in h) for _, h in asked)
        assert {h.get("Part-Key") for p, h in asked if p.startswith("/part/")} == {"0", "1"}
        n = len(asked)
        with pytest.raises(Exception, match="NotFound: " + "x" * 600):
            read("nobody").count()
        assert len(asked) == n + 1
    finally:
        server.shutdown()


def test_indexes_are_parsed_once_for_each_state(made, tmp_path, monkeypatch):  # noqa: F811
    path, _ = made
    shutil.copy(path + ".bai", tmp_path / "one.bai")
    parsed = []
    monkeypatch.setattr(source.index, "parse", lambda data, real=source.index.parse: parsed.append(1) or real(data))
    ask = {"path": path, "index": str(tmp_path / "one.bai")}
    first = source.open_index(ask)
    assert source.open_index(ask) is first and len(parsed) == 1
    shutil.copy(path + ".csi", tmp_path / "one.bai")
    assert source.open_index(ask).kind == "csi" and len(parsed) == 2
    for k in range(6):
        shutil.copy(path + ".bai", tmp_path / f"{k}.bai")
        source.open_index({"path": path, "index": str(tmp_path / f"{k}.bai")})
    assert len(sys.modules["_readloom_indexes"].by_state) == 5


def test_records_of_the_callers_own_kind(spark, made):  # noqa: F811
    path, rows = made
    own = source.read_bam(spark, path, record=lambda df: df.select("name", (F.col("end") - F.col("start")).alias("width")))
    assert own.columns == ["name", "width"] and own.count() == len(rows)
    some = source.read_bam(spark, path, columns="raw,tags_start,flag_nc")
    assert some.where(F.length("raw") >= F.col("tags_start")).count() == len(rows)


def test_arriving_files_are_read_once(spark, made, tmp_path):  # noqa: F811
    path, rows = made
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    source.register(spark)

    def drain():
        run = spark.readStream.format("bam").option("columns", "ref_name,flags").option("rename", "chr1=one").load(str(folder)).writeStream.format("parquet")
        run = run.option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(processingTime="0 seconds").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
        return spark.read.parquet(str(out / "rows"))

    for k in range(3):
        shutil.copyfile(path, folder / f"{k}.bam")
        assert drain().count() == (k + 1) * len(rows)
    assert drain().where("ref_name = 'one'").count() == 3 * sum(r.get("ref_id") == 0 for r in rows)


def test_null_paths_raise(spark):
    source.register(spark)
    with pytest.raises(Exception, match="no source"):
        spark.read.format("bam").load().count()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_htsget_errors():
    assert htsget.error_text(b'{"htsget": {"error": "NotFound", "message": "no such id"}}') == "NotFound: no such id"
    assert htsget.error_text(b"plain") == "plain"
    assert htsget.records_offset(b"no header") == 0
    with pytest.raises(bgzf.Truncated):
        htsget.records_offset(b"BAM\1" + b"\x10\0\0\0")


def test_alignment_file_follows_the_orders_table(spark, tmp_path):
    def put(n):
        shutil.rmtree(tmp_path / "orders.parquet", ignore_errors=True)
        spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(n).write.parquet(str(tmp_path / "orders.parquet"))

    put(40)
    old = bam_file(spark, str(tmp_path))
    assert bam_file(spark, str(tmp_path)) == old and source.read_bam(spark, old).count() == 40
    put(25)
    assert source.read_bam(spark, bam_file(spark, str(tmp_path))).count() == 25


def _peak(run):
    """Bytes that Python holds at most while it runs."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_driver_never_holds_an_alignment_file(spark, monkeypatch):
    def whole(self):
        assert ".bam" not in self.path or self.path.endswith((".bai", ".csi")), f"all of {self.path} at once"
        return b"".join(self.chunks())

    held = []
    monkeypatch.setattr(bgzf.Source, "all", whole)
    monkeypatch.setattr(queries, "put", lambda s, path, parts, real=shared.put: real(s, path, [held.append(len(p)) or p for p in parts]))
    sf = "/root/testdata/sf0.001"
    assert sum(r.n for r in queries.QUERIES["g9_arriving_files"](spark, sf).collect()) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert queries.QUERIES["io_htsget"](spark, sf).count() > 0
    assert max(held, default=0) < 1000
    path = bam_file(spark, sf)
    assert bgzf.Source(path + ".arrivals/one.bam").size() == bgzf.Source(path).size() == sum(bgzf.Source(f"{path}.{p}").size() for p in ("head", "rest"))


def test_an_index_is_gathered_without_the_places_of_all_records():
    places = [(r, a // 20, a // 20 + 90, (r * 100_000 + a) * 200, a % 7 > 0) for r in range(2) for a in range(100_000)]
    found = writer.Gathered()
    assert _peak(lambda: [None for p in places if found.append(p)]) < 1 << 20
    for kind in ("bai", "csi"):
        assert writer.index_bytes(found, 3, 200_000 * 200, kind) == writer.index_bytes(places, 3, 200_000 * 200, kind)


def test_executors_encode_the_alignment_file(spark, monkeypatch, tmp_path):
    """In parts of any size, and as one writer would; the driver encodes no record."""
    driver, encode = os.getpid(), writer.encode_record

    def elsewhere(r):
        assert os.getpid() != driver, "a record encoded by the driver"
        return encode(r)

    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [derive._record(*r) for r in derive.order_reads(spark, str(tmp_path)).orderBy("ref_id", "start", "record_id").select("record_id", "ref_id", "start", "span", "flags", "raw_mq").collect()]
    places = writer.Gathered()
    whole = b"".join(writer.bam_blocks(derive.TEXT, derive.REFS, rows, places, derive.BLOCK, 0))
    monkeypatch.setattr(writer, "encode_record", elsewhere)
    for k in (40, derive.ROWS):
        monkeypatch.setattr(derive, "ROWS", k)
        path = bam_file(spark, str(tmp_path))
        assert bgzf.Source(path).all() == whole
        for kind in ("bai", "csi"):
            assert bgzf.Source(f"{path}.{kind}").all() == writer.index_bytes(places, len(derive.REFS), len(whole) - len(bgzf.EOF_BLOCK) << 16, kind)
        assert not [p for p in Path(path.removeprefix("file://")).parent.iterdir() if ".parts-" in p.name]
        Path(path.removeprefix("file://") + ".csi").unlink()  # made anew


def test_an_alignment_file_of_no_records(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    path = bam_file(spark, str(tmp_path))
    assert bgzf.Source(path).all() == b"".join(writer.bam_blocks(derive.TEXT, derive.REFS, [], [], derive.BLOCK, 0))
    assert source.read_bam(spark, path).count() == 0


@pytest.mark.parametrize("block", [150, 240, 1000, 60_000])
def test_parts_join_to_the_file_that_one_writer_makes(tmp_path, block):
    rng = random.Random(block)
    rows = [derive._record(i, r, a, rng.randrange(1, 90), rng.choice([0, 4, 16]), 9) for i, (r, a) in enumerate(sorted((rng.randrange(3), rng.randrange(40_000)) for _ in range(400)))]
    size, refs = [0, *accumulate(len(writer.encode_record(r)) for r in rows)], derive.REFS
    base = len(b"".join(writer.bam_blocks("@HD\n", refs, [], [], block, 0))) - len(bgzf.EOF_BLOCK)
    one = writer.Gathered()
    whole = b"".join(writer.bam_blocks("@HD\n", refs, rows, one, block, 0))
    for n in (1, 2, 7, 400):
        cuts = [0, *sorted(rng.sample(range(1, 400), n - 1)), 400]
        parts, places = [], writer.Gathered()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            own = writer.Gathered()
            (tmp_path / f"{n}-{i}").write_bytes(b"".join(writer.stored_part(rows[a:b], size[a], size[b], base, own, block)))
            places.extend(own, writer.stored_offset(size[a], base, block))
            parts.append((str(tmp_path / f"{n}-{i}"), size[a], size[b]))
        assert b"".join(writer.joined_parts("@HD\n", refs, parts, lambda p, at, k: Path(p).read_bytes()[at:at + k], block)) == whole
        for kind in ("bai", "csi"):
            assert writer.index_bytes(places, len(refs), len(whole) - len(bgzf.EOF_BLOCK) << 16, kind) == writer.index_bytes(one, len(refs), len(whole) - len(bgzf.EOF_BLOCK) << 16, kind)
    with pytest.raises(ValueError, match="counted"):
        list(writer.stored_part(rows[:2], 0, size[2] + 1, base, writer.Gathered(), block))


def test_pieces_of_files_are_written_in_their_place(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(200)))
    made = f"file://{tmp_path}/made"
    assert shared.put(spark, made, [b"x", shared.Piece(f"file://{tmp_path}/a", 10, 100), b"yz"]) == 103
    assert (tmp_path / "made").read_bytes() == b"x" + bytes(range(10, 110)) + b"yz"
    with pytest.raises(OSError, match="190 bytes"):
        shared.put(spark, made, [shared.Piece(f"file://{tmp_path}/a", 10, 300)])


def test_htsget_unpacks_a_reply_part_by_part(tmp_path):
    block = bgzf.deflate(bytes(60_000), 0)
    names = [str(tmp_path / k) for k in ("a", "b")]
    for n in names:
        Path(n).write_bytes(block * 200)
    reply = "data:," + json.dumps({"htsget": {"urls": [{"url": n} for n in names]}})
    assert _peak(lambda: sum(map(len, htsget.Client({}).fetch(reply)))) < 6 << 20
    assert sum(map(len, htsget.Client({}).fetch(reply))) == 2 * 200 * 60_000
    Path(names[1]).write_bytes(block[:-5])
    with pytest.raises(bgzf.Truncated):
        list(htsget.Client({}).fetch(reply))


def test_records_of_a_long_reply_carry_over_windows(spark, made, monkeypatch):  # noqa: F811
    path, rows = made
    monkeypatch.setattr(htsget, "WINDOW", 1000)
    reader = htsget.HtsgetReader({"path": "https://h/x", "replies": json.dumps({f"https://h/x?{q}format=BAM": "data:," + json.dumps({"htsget": {"urls": [{"url": path}]}}) for q in ("class=header&", "")})})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    names = [n for b in got for n in b.column("name").to_pylist()]
    assert len(got) > 3 and names == [r.name for r in sorted(source.read_bam(spark, path).select("name", "record_id").collect(), key=lambda r: r.record_id)]
    ids = [i for b in got for i in b.column("record_id").to_pylist()]
    assert ids == sorted(set(ids)) and len(ids) == len(rows)
