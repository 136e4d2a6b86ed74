"""What comes from outside, with processes and servers of this machine."""

import hashlib
import http.server
import json
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from codelode.operators import governance
from codelode.sources import remote


def test_a_clone_is_made_once(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=N", "-c", "user.email=N@x", *a], check=True, capture_output=True, text=True).stdout
    (tmp_path / "r").mkdir()
    run("init", "-q")
    (tmp_path / "r/a").write_text("1")
    run("add", "."), run("commit", "-qm", "x")
    sha = run("rev-parse", "HEAD").strip()
    folder = remote.materialize(str(tmp_path / "r"), sha, str(tmp_path / "cache"))
    assert remote.materialize(str(tmp_path / "r"), sha, str(tmp_path / "cache")) == folder
    with pytest.raises(ValueError):
        remote.materialize(str(tmp_path / "r"), "main", str(tmp_path / "cache"))


def test_indexers_publish_only_what_is_whole(tmp_path):
    (tmp_path / "root").mkdir()
    out = str(tmp_path / "out/index.scip")
    py = lambda code: [sys.executable, "-c", code]
    assert remote.run_indexer(py("open('i', 'w').write('x')"), str(tmp_path / "root"), "i", out, 60) == out
    with pytest.raises(FileNotFoundError):
        remote.run_indexer(py("pass"), str(tmp_path / "root"), "i", out, 60)
    with pytest.raises(subprocess.TimeoutExpired):
        remote.run_indexer(py("import time; time.sleep(30)"), str(tmp_path / "root"), "i", out, 0.5)


def test_bundles_are_checked(tmp_path):
    (tmp_path / "p").write_bytes(b"data")
    good = {"payload": "p", "size": 4, "sha256": hashlib.sha256(b"data").hexdigest(), "network": "DENIED"}
    put = lambda m: (tmp_path / "manifest.json").write_text(json.dumps(m))
    put(good)
    assert remote.accept_bundle(str(tmp_path)) == good
    for bad in ({"size": 5}, {"sha256": "0"}, {"network": "ALLOWED"}, {"payload": "../p"}):
        put(good | bad)
        with pytest.raises(ValueError):
            remote.accept_bundle(str(tmp_path))


def test_embedding_servers_are_local():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"embeddings": [[0.5, 1]]}')

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert remote.embed_locally(url, "m", "t", 2) == [0.5, 1.0]
    with pytest.raises(ValueError):
        remote.embed_locally(url, "m", "t", 3)
    with pytest.raises(ValueError):
        remote.embed_locally("http://192.0.2.1", "m", "t", 2)
    server.shutdown()


def test_workspaces_and_bindings(spark):
    w = spark.createDataFrame([("a", "A", "ACTIVE", None), ("b", "B", "ARCHIVED", None)], "workspace_id string, name string, status string, archived_at timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    change = lambda *rows: spark.createDataFrame(rows, "workspace_id string, name string, action string").withColumn("at", now)
    after = governance.change_workspaces(w, change(("a", None, "ARCHIVE"), ("c", "C", "CREATE")))
    assert {r["workspace_id"]: (r["name"], r["status"]) for r in after.collect()} == {"a": ("A", "ARCHIVED"), "b": ("B", "ARCHIVED"), "c": ("C", "ACTIVE")}
    with pytest.raises(Exception, match="can't be changed"):
        governance.change_workspaces(w, change(("b", None, "ARCHIVE"))).collect()
    held = spark.createDataFrame([("a", "p", "s1"), ("b", "p", "s1")], "workspace_id string, project_id string, snapshot_id string")
    done = governance.bind(held, spark.createDataFrame([("a", "p", "s2"), ("a", "q", "s3"), ("b", "p", None)], held.schema), w)
    assert sorted(map(tuple, done.collect())) == [("a", "p", "s2"), ("a", "q", "s3"), ("b", "p", "s1")]
