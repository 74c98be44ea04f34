import hashlib

from pyspark.sql import functions as F

from parasift.llm import fixity


def _records(spark, rows):
    return spark.createDataFrame(rows, "archive string, offset long, record binary, extra string")


def _archive(name, n, damage=()):
    at, rows = 0, []
    for i in range(n):
        body = bytearray(f"record {i} ".encode() * (3 + i % 5))
        rows.append((name, at, bytes(body) if i not in damage else bytes(body[:-1]) + b"!", "x"))
        at += len(body)
    return rows


def _audit(spark, a, b, range_bytes=256, fanout=4):
    good, copy = fixity.digests(_records(spark, a)), fixity.digests(_records(spark, b))
    levels = max(fixity.depth(good, range_bytes, fanout), fixity.depth(copy, range_bytes, fanout))
    trees = [fixity.tree(x, levels, range_bytes, fanout) for x in (good, copy)]
    return fixity.audit(*trees).collect(), trees


def test_finds_every_damaged_record(spark):
    good = _archive("a", 300) + _archive("b", 50) + [(None, 0, b"null archive", "x"), ("c", None, None, "x")]
    copy = _archive("a", 300, {7, 150, 299}) + _archive("b", 50)[:-1] + [(None, 0, b"null archive", "x"), ("c", None, None, "x"), ("d", 5, b"new", "x")]
    rows, _ = _audit(spark, good, copy)
    at = {("a", good[i][1], "changed") for i in (7, 150, 299)} | {("b", good[349][1], "missing"), ("d", 5, "extra")}
    assert {(r["archive"], r["offset"], r["problem"]) for r in rows} == at
    one = next(r for r in rows if r["offset"] == good[7][1] and r["archive"] == "a")
    assert one["digest_good"] == hashlib.sha256(good[7][2]).hexdigest()


def test_equal_and_empty_replicas(spark):
    rows = _archive("a", 20) * 2  # repeated rows
    assert _audit(spark, rows, rows)[0] == []
    assert _audit(spark, [], [])[0] == []
    assert len(_audit(spark, _archive("a", 20), [])[0]) == 20


def test_root_is_a_merkle_root(spark):
    rows = _archive("a", 40)
    _, (tree, _) = _audit(spark, rows, rows, range_bytes=128, fanout=2)
    leaves = {}
    for _, at, rec, _ in rows:
        leaves.setdefault(at // 128, []).append(f"{at} {len(rec)} {hashlib.sha256(rec).hexdigest().upper()}")
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in leaves.items()}
    for _ in tree.levels[1:]:
        up = {}
        for k in sorted(level):
            up.setdefault(k // 2, []).append(f"{k} {level[k].upper()}")
        level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
    root = tree.levels[-1].select(F.lower(F.hex("hash"))).collect()
    assert [r[0] for r in root] == [level[0]] and len(level) == 1


def test_warc_record(spark):
    df = spark.createDataFrame([("http://x/", "é", 3), (None, None, None)], "u string, h string, i long")
    recs = [r[0] for r in df.select(fixity.warc_record(F.col("u"), F.col("h"), F.col("i"))).collect()]
    head, _, body = bytes(recs[0]).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.0\r\n") and b"Content-Length: 2" in head and body == "é".encode() + b"\r\n\r\n"
    assert b"Content-Length: 0" in bytes(recs[1])
