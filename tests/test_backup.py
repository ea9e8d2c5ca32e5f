import random

from pyspark.sql import functions as F

from sparkfold.operators.chunking import SMALL
from sparkfold.plans.backup import download, upload
from sparkfold.plans.reports import LOGS, write_logs
from sparkfold.plans.store import Options, Store


def test_files_go_in_and_out(spark, tmp_path):
    data = random.Random(1).randbytes(40_000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(data)
    (tmp_path / "in" / "b.bin").write_bytes(data[:20_000] + b"new" + data[20_000:])
    store = Store(spark, f"file://{tmp_path}/store", Options(plain_prefix="zz"))
    done = upload(store, f"{tmp_path}/in", SMALL)
    assert done["files"] == 2 and done["bytes"] == 80_003
    for name in ("a.bin", "b.bin"):
        backup = next(r.backup_id for r in store.table("recipes").select("backup_id").distinct().collect() if r.backup_id.endswith(name))
        got = download(store, backup, f"file://{tmp_path}/{name}")
        assert (tmp_path / name).read_bytes() == (tmp_path / "in" / name).read_bytes() and got["bytes"] == len((tmp_path / name).read_bytes())
    rows = {n: log(store).collect() for n, log in LOGS.items()}
    assert len(rows["server"]) == 2 and rows["server"][-1].reduction > 0 and rows["chunk"][-1].logical_bytes == 80_003
    write_logs(store, f"file://{tmp_path}/logs")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/logs/server-log").count() == 2


def test_parts_of_a_backup_can_be_bases_of_later_parts(spark, tmp_path):
    r = random.Random(2)
    one = [r.randbytes(1500) + b"plain text " * 150 for _ in range(8)]
    two = [d[:30] + b"edited here" + d[41:] for d in one]
    rows = [(i, bytearray(d)) for i, d in enumerate(one + two)]
    df = spark.createDataFrame(rows, "seq long, chunk binary")
    store = Store(spark, f"file://{tmp_path}/store", Options(policy="inline", batch=4))
    store.ingest_in_parts("b", df, 2)
    assert store.table("chunks").filter("is_delta").count() > 0 and store.table("metrics").count() == 2
    assert {x.seq: bytes(x.chunk) for x in store.restore("b").collect()} == {i: bytes(d) for i, d in rows}
    assert store.table("metrics").agg(F.sum("logical_chunks")).first()[0] == 16
