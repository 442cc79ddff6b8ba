"""The source of captured fetches: attempts, status, odd lines, and a stream that is started anew."""

import json

from tessera.sources import captures


def log(folder, name, rows):
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(dict(zip(("page_id", "url", "status", "html"), r))) for r in rows))


def test_attempts():
    tried = lambda *rows: captures.fetched(iter([dict(zip(("page_id", "url", "status", "html"), (1, "u", *r))) for r in rows]))
    assert tried((200, "a"), (200, "b")) == (1, "u", 200, 1, "a")
    assert tried((500, "x"), (204, ""), (200, "b")) == (1, "u", 204, 2, "")
    assert tried((500, "x"), (200, None), (404, "y"), (200, "late")) == (1, "u", 404, 3, None)
    assert tried((None, "x")) == (1, "u", None, 1, None)


def test_batch_and_restarted_stream(spark, tmp_path):
    captures.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    read = lambda: sorted((r["page_id"], r["attempts"], r["html"]) for r in spark.read.format("captures").option("path", str(logs)).load().collect())
    assert read() == []
    log(logs, "a-1", [(1, "u", 200, "one"), "not json", "[1]", (2, "v", 500, None), (2, "v", 200, "two \u00e9"), ""])
    log(logs, "_skip", [(9, "u", 200, "no")])
    assert read() == [(1, 1, "one"), (2, 2, "two \u00e9")]

    def run():
        pages = spark.readStream.format("captures").option("path", f"file://{logs}").load()
        pages.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        return sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2]
    log(logs, "a-2", [(3, "w", 200, "x" * 100_000), (4, None, 404, "none")])
    assert run() == [1, 2, 3, 4] and run() == [1, 2, 3, 4]
    few = spark.read.format("captures").option("path", str(logs)).option("attempts", 1).load().where("page_id = 2").first()
    assert (few["status"], few["attempts"], few["html"]) == (500, 1, None)
