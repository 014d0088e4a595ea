import pytest

from lodestone.sources import objects

SCHEMA = "object_key string, payload binary, content_type string"


def _write(spark, uri, rows, mode="append"):
    spark.createDataFrame([(k, bytearray(v), "text/plain") for k, v in rows], SCHEMA).repartition(3).write.format("objects").mode(mode).option("path", uri).save()


def _seen(spark, uri):
    return {r.object_key: bytes(r.payload) for r in objects.payloads(objects.objects(spark, uri), uri).collect()}


@pytest.fixture
def uri(spark, tmp_path):
    spark.dataSource.register(objects.ObjectSink)
    return f"file://{tmp_path}/store"


def test_put_get_delete(spark, uri, tmp_path):
    assert _seen(spark, uri) == {}
    _write(spark, uri, [("a/1/x.txt", b"one"), ("a/1/y.txt", b"two"), ("a/10/z.txt", b"one"), ("b", b"")])
    _write(spark, uri, [("a/1/x.txt", b"new")])
    assert _seen(spark, uri) == {"a/1/x.txt": b"new", "a/1/y.txt": b"two", "a/10/z.txt": b"one", "b": b""}
    assert len([p for p in (tmp_path / "store/blobs").rglob("*") if p.is_file()]) == 4  # the same bytes once
    objects.delete_prefix(uri, "a/1")
    assert sorted(_seen(spark, uri)) == ["a/10/z.txt", "b"]
    objects.delete_objects(uri, ["b", "never"])
    _write(spark, uri, [("a/1/x.txt", b"again")])
    assert _seen(spark, uri) == {"a/10/z.txt": b"one", "a/1/x.txt": b"again"}
    assert objects.vacuum(spark, uri) == 0  # all are young
    # the empty payload, one file of no bytes, stays
    assert objects.vacuum(spark, uri, older_seconds=-5) == 2 and objects.vacuum(spark, uri, older_seconds=-5) == 0
    assert _seen(spark, uri) == {"a/10/z.txt": b"one", "a/1/x.txt": b"again"}
    _write(spark, uri, [("only", b"this")], "overwrite")
    assert _seen(spark, uri) == {"only": b"this"}


def test_an_aborted_write_leaves_nothing_visible(spark, uri, tmp_path):
    _write(spark, uri, [("kept", b"1")])
    rows = [(f"k{i}", bytearray(b"x%d" % i), None) for i in range(40)] + [("../escape", bytearray(b"no"), None)]
    with pytest.raises(Exception, match="not an object key"):
        spark.createDataFrame(rows, SCHEMA).repartition(4).write.format("objects").mode("append").option("path", uri).save()
    assert _seen(spark, uri) == {"kept": b"1"}
    assert len(list((tmp_path / "store/parts").iterdir())) == 1  # part files of the aborted write are gone
    assert objects.vacuum(spark, uri, older_seconds=-5) > 0
    assert _seen(spark, uri) == {"kept": b"1"}


def test_damage_is_seen(spark, uri, tmp_path):
    _write(spark, uri, [("k", b"good")])
    next(p for p in (tmp_path / "store/blobs").rglob("*") if p.is_file()).write_bytes(b"bad")
    with pytest.raises(Exception, match="damaged"):
        _seen(spark, uri)


@pytest.mark.parametrize("key", ["", None, "/a", "a//b", "a/../b", "."])
def test_keys(key):
    with pytest.raises(objects.StorageError):
        objects.checked(key)
