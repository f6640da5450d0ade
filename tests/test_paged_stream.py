import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from claimloom.sources import paged


@pytest.fixture
def server():
    """A paged source of records (court, id, date_modified), two to a page."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urllib.parse.urlparse(self.path)
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(parts.query).items()}
            rows = [{"id": i, "date_modified": m, "court": c} for (c, i), m in sorted(self.server.rows.items()) if c == asked.get("docket__court", c) and m >= asked.get("date_modified__gte", "")]
            if asked.get("order_by") == "-date_modified":
                rows.sort(key=lambda r: r["date_modified"], reverse=True)
            at, size = int(asked.get("at", 0)), int(asked["page_size"])
            asked["at"] = at + size
            more = f"http://127.0.0.1:{self.server.server_port}/?{urllib.parse.urlencode(asked)}" if at + size < len(rows) else None
            body = json.dumps({"results": rows[at : at + size], "next": more}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    found = HTTPServer(("127.0.0.1", 0), Handler)
    found.rows = {}
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield found
    found.shutdown()


def test_each_version_comes_once_over_restarts(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    server.rows.update({("a", 1): "2024-01-01T00", ("a", 2): "2024-01-02T00", ("b", 3): "2024-01-05T00", ("b", 4): ""})
    got, failing = [], []

    def keep(batch, no):
        rows = [(r.id, r.modified) for r in batch.collect()]
        if failing:
            failing.clear()
            raise RuntimeError("lost before it was kept")
        got.extend(rows)

    def run():
        source = spark.readStream.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/").option("courts", "a,b").option("page_size", "2").load()
        stream = source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    run()
    first = [("1", "2024-01-01T00"), ("2", "2024-01-02T00"), ("3", "2024-01-05T00")]
    assert sorted(got) == first
    run()
    assert sorted(got) == first  # nothing new
    server.rows.update({("a", 1): "2024-02-01T00", ("a", 9): "2024-02-02T00"})
    failing.append(1)
    with pytest.raises(Exception, match="lost before"):
        run()
    server.rows[("b", 3)] = "2024-03-01T00"
    run()  # the failed batch again, then what came after it
    assert sorted(got) == sorted([*first, ("1", "2024-02-01T00"), ("9", "2024-02-02T00"), ("3", "2024-03-01T00")])


def test_bounds_of_a_batch(server):
    server.rows.update({("a", i): f"2024-01-0{i}" for i in range(1, 8)})
    reader = paged.PagedStream({"url": f"http://127.0.0.1:{server.server_port}/", "courts": "a", "since": "2024-01-02", "page_size": "2"})
    start, end = reader.initialOffset(), {"a": "2024-01-05"}
    assert reader.latestOffset() == {"a": "2024-01-07"} and start == {"a": "2024-01-02"}
    (span,) = reader.partitions(start, end)
    assert [r[1] for r in reader.read(span)] == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert reader.partitions(end, end) == []
