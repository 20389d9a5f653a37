"""Operators against small sequential models and known cases."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapweave.functions import codec, globs, refs
from snapweave.operators import account, blocks, chunks, clean, rebuild, reconcile, retain, verify
from snapweave.sources import catalog as schema
from snapweave.sources import config, publish, segments, stanzas, tree

GLOBS = {
    # pattern and base: paths that it matches, paths that it doesn't
    ("notes/", ""): (["notes/", "2023/notes/"], ["notes", "mynotes/", "notes/x"]),
    ("report-?.pdf", ""): (["report-7.pdf", "q1/q2/report-x.pdf", "report-\n.pdf"], ["report-10.pdf", "report-/.pdf"]),
    ("draft*", ""): (["draft", "a/drafts", "a/draft\n2"], ["a/draft/b", "redraft"]),
    ("/build", ""): (["build", "build/"], ["lib/build"]),
    ("/src/*.h", ""): (["src/x.h", "src/.h"], ["src/sub/x.h", "lib/src/x.h"]),
    ("/src/**.h", ""): (["src/x.h", "src/sub/deep/x.h", "src/li\nne/x.h"], ["src/x.c"]),
    ("tmp/cache", "var"): (["var/tmp/cache", "var/lib/tmp/cache"], ["tmp/cache", "varx/tmp/cache"]),
    ("/cache", "var/lib"): (["var/lib/cache"], ["var/lib/x/cache", "var/cache"]),
    ("x", "od[d]"): (["od[d]/x"], ["odd/x"]),
    ("(a|b)+{2}^$.", ""): (["(a|b)+{2}^$.", "d/(a|b)+{2}^$."], ["aa", "b"]),
    ("", "any"): (["", "whatever/there is"], []),
}


def test_globs(spark):
    for (pattern, base), (hits, misses) in GLOBS.items():
        rows = spark.createDataFrame([(p,) for p in hits + misses], "path string")
        got = [r.path for r in rows.where(F.col("path").rlike(globs.glob_to_regex(pattern, base))).collect()]
        assert sorted(got) == sorted(hits), (pattern, base)


def test_rules_order_and_pruning(spark):
    rules = globs.parse_rules("  # nothing but logs of today\n+ today.log\n\t-   *.log\n? *.txt\n-\n", "var")
    assert [r[0] for r in rules] == [True, False]
    paths = spark.createDataFrame([("var/today.log",), ("var/a/old.log",), ("etc/old.log",)], "path string")
    assert {r.path for r in globs.filter_paths(paths, rules).collect()} == {"var/today.log", "etc/old.log"}
    drop = globs.parse_rules("- /skip/")
    rows = spark.createDataFrame([("skip/a/b",), ("keep/a",), ("skip/",)], "path string")
    assert [r.path for r in globs.filter_paths(rows, drop).collect()] == ["keep/a"]


def test_merge_precedence():
    files = [("", "- x"), ("a/b", "+ x")]
    assert [r[0] for r in globs.merged_rules([], files)] == [True, False]
    assert [r[0] for r in globs.merged_rules([], files, "as_coded")] == [False, True]


def test_codecs(spark):
    cases = [("", ""), ("plain/path-1.txt", "plain/path-1.txt"), ("two words", "two%20words"), ("10% @home", "10%25%20%40home"), ("Äpfel\n€", "%c3%84pfel%0a%e2%82%ac"), ("\x7f+,~*", "%7f+,~%2a")]
    rows = spark.createDataFrame(cases, "raw string, encoded string")
    for r in rows.select("*", codec.uri_encode(F.col("raw")).alias("e"), codec.uri_decode(F.col("encoded")).alias("d")).collect():
        assert r.e == r.encoded and bytes(r.d) == r.raw.encode()
    odd = spark.createDataFrame([("latin %fc",), ("50%",), ("%4",), ("%g0%41",)], "t string").select(codec.uri_decode(F.col("t")).alias("d")).collect()
    assert [bytes(r.d) for r in odd] == [b"latin \xfc", b"50%", b"%4", b"%g0A"]


def test_integers(spark):
    cases = [("0", 0), ("10", 10), ("-7", -7), ("0755", 493), ("0x1f", 31), ("-0x10", -16), ("", None), ("zz", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, n long").select("n", codec.parse_int(F.col("t")).alias("got")).collect()
    assert all(r.n == r.got for r in rows)


def test_intervals(spark):
    assert codec.interval_seconds("1Y2M3W4D5h6m7s") == 365 * 86400 + 60 * 86400 + 21 * 86400 + 4 * 86400 + 5 * 3600 + 367
    rows = spark.createDataFrame([("1D12h",), ("x",)], "t string").select(codec.interval_column(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [129600, None]
    with pytest.raises(ValueError):
        codec.interval_seconds("5")


def test_references(spark):
    good = ["a7-b/000001ad", "a7-b/000001ad(sha1=67)", "a7-b/000001ad(sha1=67)[264+1000]", "a7-b/01[1000]", "zero[1024]", "@a7/0f"]
    rows = spark.createDataFrame([(t,) for t in good + ["x y", "", None]], "t string").withColumn("r", refs.parse_ref(F.col("t"))).withColumn("p", refs.format_ref(F.col("r"))).collect()
    assert [r.p for r in rows] == good + ["null"] * 3
    assert rows[3].r.exact and rows[3].r.start == 0 and not rows[2].r.exact and rows[4].r.kind == "zero"


def sequential_use(size, lengths):
    used = 0
    for n in lengths:
        used = size if n >= size else used if used == size else min(used + n, size - 1)
    return used


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.lists(st.integers(1, 25), min_size=1, max_size=5)), min_size=1, max_size=8))
def test_use_objects(spark, cases):
    rows = [(1, i, "o", n, size) for i, (size, lengths) in enumerate(cases) for n in lengths]
    got = {r.segmentid: r.size for r in account.use_objects(spark.createDataFrame(rows, "snapshotid int, segmentid int, object string, length long, size long")).collect()}
    assert got == {i: sequential_use(size, lengths) for i, (size, lengths) in enumerate(cases) if size > 0}


def test_pack_segments(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    got = blocks.pack_segments(spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "group string, object_order int, size long"), 100, slots=1).orderBy("object_order").collect()
    seg = filled = no = 0
    for r, s in zip(got, sizes):
        if filled >= 100:
            seg, filled, no = seg + 1, 0, 0
        assert (r.segment_no, r.object_no) == (seg, no)
        filled, no = filled + s, no + 1
    many = blocks.pack_segments(spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "group string, object_order int, size long"), 100, slots=4)
    assert many.count() == 200 and many.groupBy("slot", "segment_no").count().count() >= 4


def test_bucket_cutoffs():
    def sequential(age, cuts):
        out = None
        for i, c in enumerate(cuts):
            if age > c:
                out = i
        return out

    cuts = clean.bucket_cutoffs([(a, 100) for a in range(40)], 150)
    assert cuts[0] == -1 and cuts == sorted(cuts) and sequential(40, cuts) == len(cuts) - 1
    assert clean.bucket_cutoffs([], 10) == [-1]
    # by hand: a mean of 10 and 160 bytes give a target of 26.4; the 12 bytes of days 5 and 4 join those of days 7 and 6
    assert clean.bucket_cutoffs([(9, 20), (8, 60), (7, 15), (6, 15), (5, 6), (4, 6), (3, 18), (1, 10), (0, 10)], 10) == [-1, 0, 3, 7]


def test_retention_edges(spark):
    rows = spark.createDataFrame([(1, "s", "2019-12-30 00:00:00"), (2, "s", "2020-01-01 00:00:00"), (3, "s", "2020-01-06 00:00:00")], "snapshotid int, scheme string, ts string").select("snapshotid", "scheme", F.col("ts").cast("timestamp_ntz").alias("timestamp"))
    now = F.lit("2020-01-07 00:00:00").cast("timestamp_ntz")
    got = {(r["class"], r.snapshotid): r.retained for r in retain.labels(rows, {"weekly": 86400, "yearly": 10**9}, now).collect()}
    # 30 December and 1 January are one ISO week; an age equal to the period is not retained
    assert got == {("weekly", 1): False, ("weekly", 3): False, ("yearly", 1): True, ("yearly", 2): True}


def test_chunk_breaks():
    def slow(data):
        out, x, hist = [0], 0, [0] * chunks.WINDOW

        def times(b, bits):
            v = b
            for _ in range(bits):
                v <<= 1
                if v >> 63:
                    v ^= chunks.MODULUS
            return v

        undo = [times(b, 8 * (chunks.WINDOW - 1)) for b in range(256)]
        for i, b in enumerate(data):
            x ^= undo[hist[i % chunks.WINDOW]]
            x = times(x, 8) ^ b
            hist[i % chunks.WINDOW] = b
            n = i - out[-1] + 1
            if (x % chunks.TARGET == chunks.MARK and n >= chunks.LEAST) or n >= chunks.MOST:
                out.append(i + 1)
        return out if out[-1] == len(data) else [*out, len(data)]

    data = random.Random(2).randbytes(60000)
    assert chunks.breaks(data) == slow(data)
    assert chunks.breaks(b"") == [0] and chunks.breaks(b"a" * 70000) == [0, 65535, 70000]
    parts = [(5, b"x" * 28), (7, b"\0" * 28)]
    assert chunks.unpack_signatures(chunks.pack_signatures(parts)) == [(0, 5, b"x" * 28), (5, 7, None)]


def test_incremental_rebuilds(spark):
    rng = random.Random(3)
    old, extra = rng.randbytes(400000), rng.randbytes(3000)
    new = old[:200000] + extra + old[200000:]
    schema = "file string, pos int, block binary"
    o = chunks.chunked(spark.createDataFrame([("f", 0, old)], schema), ("file",)).withColumns({"segment": F.lit("s"), "object": F.lit("o")})
    n = chunks.chunked(spark.createDataFrame([("f", 0, new), ("g", 0, extra)], schema), ("file", "pos"))
    out = chunks.incremental(chunks.matched(n, o)).orderBy("file", "first_pos").collect()
    fresh = b"".join(new[r.offset : r.offset + r.length] for r in chunks.matched(n, o).where("file = 'f' and old is null").orderBy("chunk_no").collect())
    assert b"".join((old if r.kind == "old" else fresh)[r.start : r.start + r.length] for r in out if r.file == "f") == new
    assert len(fresh) < 100000 and [r.kind for r in out if r.file == "g"] == ["whole"]


def test_content_digest_and_fetch(spark):
    objects = spark.createDataFrame([("s", "1", b"hello world"), ("s", "2", b"abc")], "segment string, object string, content binary")
    rows = spark.createDataFrame([("f", 0, "s/1[0+5]"), ("f", 1, "zero[2]"), ("f", 2, "s/2[3]"), ("g", 0, "s/2[4]"), ("h", 0, "s/9")], "file string, pos int, t string")
    got = verify.fetch(rows.withColumn("r", refs.parse_ref(F.regexp_replace("t", "^s", "5"))).select("file", "pos", "r.*").withColumn("segment", F.when(F.col("segment") == "5", "s")), objects)
    assert {(r.file, r.pos): r.fetch_ok for r in got.collect()} == {("f", 0): True, ("f", 1): True, ("f", 2): True, ("g", 0): False, ("h", 0): False}
    d = {r.file: r for r in verify.content_digest(got, "file", "pos").collect()}
    assert d["f"].checksum == "sha224=" + hashlib.sha224(b"hello\0\0abc").hexdigest() and d["f"].size == 10


def test_stanzas(spark):
    text = "name: a%20b\ntype: f\nmode: 0644\nuser: 1000 (joe)\nsize: 12\ndata: x/1\n y/2\nname: last\nodd: 1"
    row = stanzas.typed_items(spark.createDataFrame([(text,)], "t string").select(stanzas.parse_stanza(F.col("t")).alias("fields"))).first()
    assert (row.name, row.mode, row.user.id, row.user.name, row.size, row.data, row.fields["odd"]) == ("last", 420, 1000, "joe", 12, ["x/1", "y/2"], "1")
    lines = spark.createDataFrame([([0], "a"), ([1], "@r"), ([2], "z")], "place array<int>, line string")
    logs = spark.createDataFrame([("r", 0, "b"), ("r", 1, "@q"), ("q", 0, "c")], "ref string, no int, line string")
    assert [r.line for r in stanzas.expand(lines, logs).orderBy("place").collect()] == ["a", "b", "c", "z"]
    v = spark.createDataFrame([([0, 11],), ([0, 12],), (None,)], "v array<int>").select(stanzas.version_ok(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in v] == [True, False, True]


def test_segments_round_trip(spark, tmp_path):
    objects = spark.createDataFrame([("s1", "00000000", b"abc"), ("s1", "00000001", b""), ("s2", "00000000", b"z" * 1000)], "segment string, object string, content binary")
    for r in segments.build_segments(objects).collect():
        (tmp_path / f"{r.segment}.tar.bz2").write_bytes(r.archive)
    got = segments.read_segments(spark, str(tmp_path))
    assert {(r.segment, r.object, bytes(r.content)) for r in got.collect()} == {("s1", "00000000", b"abc"), ("s1", "00000001", b""), ("s2", "00000000", b"z" * 1000)}


def test_tree_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("hello")
    (tmp_path / "l").symlink_to("d")
    rows = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}
    assert rows["d"].type == "d" and rows["d/x"].size == 5 and rows["l"].target == "d"
    assert {r.path for r in tree.contents(spark, str(tmp_path / "d")).collect()} == {"x"}


def test_changed_and_merge(spark):
    s = "path string, ctime long, mtime long, size long, inode string"
    now = spark.createDataFrame([("a", 1, 1, 1, "i"), ("b", 1, 2, 1, "i"), ("c", 1, 1, 1, None), ("d", 1, 1, 1, "i")], s)
    before = spark.createDataFrame([("a", 1, 1, 1, "i"), ("b", 1, 1, 1, "i"), ("c", 1, 1, 1, None)], s)
    assert {r.path: r.state for r in reconcile.changed(now, before).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "added"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, content string")
    assert blocks.split_blocks(empty, 4).count() == 0
    assert account.use_objects(spark.createDataFrame([], "snapshotid int, segmentid int, object string, length long, size long")).count() == 0
    assert blocks.split_blocks(spark.createDataFrame([(1, ""), (2, None), (3, "abcde")], "doc_id long, content string"), 4).count() == 2


def fold_of_buckets(days, mean, min_age=4):
    """Days from the oldest on, one at a time, as (ages that start a bucket, least cut)."""
    total = sum(b for _, b in days)
    target = max(2 * mean, total / (2 * (total / mean) ** 0.4))
    buckets, young = [[]], False
    for age, size in sorted(days, reverse=True):
        full = sum(b for _, b in buckets[-1]) >= target
        if age < min_age and not young:
            young = True
            if not full and len(buckets) > 1:
                last = buckets.pop()
                buckets[-1] = buckets[-1] + last
            buckets.append([])
        elif full:
            buckets.append([])
        buckets[-1].append((age, size))
    starts = [b[0][0] for b in buckets[1:]]
    if sum(b for _, b in buckets[-1]) >= 1.5 * mean or not young:
        starts.append(-1)
    return [-1, *reversed(starts)]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 500), min_size=1), st.integers(1, 400))
def test_bucket_cutoffs_against_a_fold(days, mean):
    assert clean.bucket_cutoffs(list(days.items()), mean) == fold_of_buckets(list(days.items()), mean)


def test_positions_and_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "ü", ""]), rng.randrange(50), [rng.choice("xyz")] * rng.randrange(3)) for _ in range(500)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "s string, n int, l array<string>")
    got = reconcile.positions(df, ["s", "l", "n"]).collect()
    assert sorted(r.place for r in got) == list(range(503))
    key = lambda r: (r.s is not None, (r.s or "").encode(), r.l is not None, r.l or [], r.n is not None, r.n or 0)
    assert [key(r) for r in sorted(got, key=lambda r: r.place)] == sorted(map(key, got))
    assert reconcile.positions(df.limit(0), ["s"]).count() == 0
    known = spark.createDataFrame([(7, "b"), (3, "a")], "segmentid long, segment string")
    names = spark.createDataFrame([("d",), ("a",), (None,), ("c",), ("c",)], "segment string")
    assert sorted(map(tuple, reconcile.with_ids(known, names).collect())) == [(3, "a"), (7, "b"), (8, "c"), (9, "d")]
    assert reconcile.with_ids(known.limit(0), names).count() == 3


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "x", 1), (2, "c", 2), (3, None, 1), (3, None, 1)], "k int, v string, no int")
    assert sorted(map(tuple, reconcile.upsert(table, rows, ["k"], "no").collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(map(tuple, reconcile.upsert(table, rows.drop("no"), ["k"]).collect())) == [(1, "a"), (2, "x"), (3, None)]
    assert sorted(map(tuple, reconcile.upsert(table.select("k"), rows.select("k"), ["k"]).collect())) == [(1,), (2,), (3,)]


def test_rule_files(spark):
    files = spark.createDataFrame([("", "- *.tmp\n- /a/skip/\n"), ("a", "+ keep.tmp\n- b/\n"), ("a/b", "+ *\n"), ("c", "x" * globs.RULE_FILE_LIMIT), (".", "- never")], "dir string, text string")
    rules = globs.rule_table(files)
    paths = ["x.tmp", "a/keep.tmp", "a/x.tmp", "keep.tmp", "a/b/y.txt", "a/skip/z", "a/skip/", "a/ok", "c/x.tmp", "d/b/e", "a/"]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths * 2)], "path string, i int")
    got = [r.path for r in globs.filter_by_rule_files(df, rules, globs.parse_rules("- /d/b/e")).collect()]
    assert sorted(got) == sorted(["a/keep.tmp", "a/ok", "a/"] * 2)
    coded = globs.filter_by_rule_files(df, rules, [], precedence="as_coded").collect()
    assert sorted({r.path for r in coded}) == ["a/", "a/ok", "d/b/e"]
    assert globs.filter_by_rule_files(df.limit(0), rules, []).count() == 0 and globs.filter_by_rule_files(df, rules.limit(0), []).count() == len(paths) * 2


def test_metadata_objects(spark):
    ref = lambda a, n: ("s", "o", a, n)
    items = [(0, 0, "aa\n\n", None), (0, 1, "bb\n\n", ref(0, 4)), (0, 2, "cc\n\n", ref(4, 4)), (0, 3, "dé\n\n", None), (0, 4, "ee\n\n", ref(90, 4)), (0, 5, "ff\n\n", ref(8, 4)), (1, 0, "gg\n\n", ref(8, 4)), (1, 1, "", None)]
    df = spark.createDataFrame(items, "slot int, place int, text string, reused struct<segment:string,object:string,start:long,length:long>")
    log = publish.metadata_log(df, 1 << 16).collect()
    whole = {r.slot: r.content for r in log if r.place is None}
    assert whole == {0: "aa\n\n@s/o[0+8]\n\ndé\n\n@s/o[90+4]\n@s/o[8+4]\n", 1: "@s/o[8+4]\n\n"}
    for r in log:
        if r.place is not None:
            assert whole[r.slot].encode()[r.offset : r.offset + r.length].decode() == items[r.place + 6 * r.slot][2]
    cut = [(r.object_no, r.content) for r in publish.metadata_log(df.where("slot = 0"), 7).collect() if r.place is None]
    assert cut == [(0, "aa\n\n@s/o[0+4]\n"), (1, "@s/o[4+4]\n\ndé\n\n"), (2, "@s/o[90+4]\n@s/o[8+4]\n")]
    entries = dict(map(tuple, publish.statcache_entries(df.where("slot = 0"), publish.metadata_log(df), F.lit("m"), F.lit("1")).collect()))
    assert entries[3] == "@@m/1[15+5]\ndé\n\n" and entries[4] == "@@s/o[90+4]\nee\n\n"
    assert publish.metadata_log(df.limit(0)).count() == 0


def test_descriptor_round_trip(spark, tmp_path):
    used = spark.createDataFrame([("b",), ("a",), ("b",)], "segment string")
    path = str(tmp_path / "snapshot-x.lbs")
    publish.publish(publish.descriptor_lines({"Format": "Snapshot v0.11", "Root": "r/1"}, used).coalesce(1), path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert text == "Format: Snapshot v0.11\nRoot: r/1\nSegments:\n    a\n    b"
    with pytest.raises(Exception, match="(?i)exist"):
        publish.publish(publish.descriptor_lines({}, used), path)
    got = spark.createDataFrame([(text,)], "t string").select(stanzas.descriptor(F.col("t")).alias("d")).select("d.*").first()
    assert (got.root, got.segments, got.version) == ("r/1", ["a", "b"], [0, 11])


def test_catalog_versions(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables = schema.empty(spark)
    schema.publish(tables, path, 1)
    more = tables | {"snapshots": spark.createDataFrame([(1, "home-20240101T000000", "home", None)], schema.SCHEMAS["snapshots"])}
    for name, df in more.items():
        if name != "segments":
            df.write.parquet(f"{path}/version=2/{name}")  # a run that failed: nothing is published
    assert schema.open_catalog(spark, path)[0] == 1
    schema.publish(more, path, 2)
    number, found = schema.open_catalog(spark, path)
    assert number == 2 and found["snapshots"].first().name == "home-20240101T000000" and found["segments"].count() == 0
    with pytest.raises(ValueError):
        schema.open_catalog(spark, path, (0, 12))


def test_config():
    policy, odd = config.retention_policy("daily:5D12h bad weekly:x yearly:1Y")
    assert policy == {"daily": 5 * 86400 + 43200, "yearly": 365 * 86400} and odd == ["bad", "weekly:x"]
    assert config.read_config("[global]\na = 1\n[backup:home]\nretain = all:1D\n") == {"[global]": {"a": "1"}, "home": {"retain": "all:1D"}}


def test_references_of_any_text(spark):
    odd = ["\x01a/0f", "a/0f\x01", "a/0f[99999999999999999999]", "a/0f[", "zero", "@zero[3]", "a/0f\n"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", refs.parse_ref(F.col("t")).alias("r")).collect()
    assert [r.r.kind for r in rows] == ["null", "null", "normal", "null", "zero", "zero", "null"]
    assert rows[2].r.length is None and rows[5].r.indirect


def test_rebuild_leaves_changed_files(spark):
    data = bytes(range(256)) * 100
    sums = [("f", data, "sha1=" + hashlib.sha1(data).hexdigest()), ("g", data, "sha1=0"), ("h", data[:10], "sha1=" + hashlib.sha1(data[:10]).hexdigest()), ("i", None, "sha1=0")]
    files = spark.createDataFrame(sums, "file string, content binary, checksum string")
    rows = [("f", 0, "normal", "s", "1", 0, 20000, True), ("f", 1, "zero", None, None, 0, 600, False), ("f", 2, "normal", "s", "2", 50, 5000, False), ("g", 0, "normal", "s", "3", 0, 25600, True), ("h", 0, "normal", "s", "4", None, None, False), ("i", 0, "normal", "s", "5", 0, 1, True)]
    refs_of = spark.createDataFrame(rows, "file string, pos int, kind string, segment string, object string, start long, length long, exact boolean")
    slices = rebuild.readable_slices(refs_of, files)
    assert {(r.object, r.size, r.checksum) for r in rebuild.rebuilt_objects(slices, "sha1").collect()} == {("1", 20000, "sha1=" + hashlib.sha1(data[:20000]).hexdigest()), ("2", 5050, None)}
    found = rebuild.rebuilt_signatures(slices, "sha1").orderBy("object", "offset").collect()
    assert [(r.offset, bytes(r.hash)) for r in found if r.object == "2"][0][0] == 50 and sum(r.length for r in found if r.object == "1") == 20000
