import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomspark import cli
from loomspark.operators import clients, connectors
from loomspark.operators.index import Index

DIM = 8


class Service:
    """Vectors by HashEmbedder in reversed order, summaries of all names; the first tries of some requests are refused, fail, or miss a vector."""

    def __init__(self):
        self.seen, self.keys, self.running, self.most, self.begins, self.lock = {}, set(), 0, 0, [], threading.Lock()
        self.refuse, self.short, self.slow = [], False, 0.0
        service = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_POST(self):
                asked = self.rfile.read(int(self.headers["Content-Length"]))
                with service.lock:
                    service.begins.append(time.monotonic())
                    service.running += 1
                    service.most = max(service.most, service.running)
                    service.keys.add(self.headers.get("Authorization"))
                    nth = service.seen[asked] = service.seen.get(asked, 0) + 1
                time.sleep(service.slow)
                status = service.refuse[nth - 1] if nth <= len(service.refuse) else 200
                reply = service.reply(json.loads(asked)) if status == 200 else {"error": "no"}
                with service.lock:
                    service.running -= 1
                body = json.dumps(reply).encode()
                self.send_response(status)
                self.send_header("x-ratelimit-limit-requests", "7000")
                self.send_header("x-ratelimit-limit-tokens", "90000000")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/v1"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def reply(self, asked):
        if "input" in asked:
            data = [{"index": i, "embedding": v} for i, v in enumerate(connectors.HashEmbedder(DIM)(asked["input"]))]
            return {"data": data[::-1][: len(data) - self.short]}
        prompt = asked["contents"][0]["parts"][0]["text"]
        names = [x.split(". ", 1)[1].split(" (")[0].split("] ")[-1].split(":")[0] for x in prompt.split("\n") if x[:1].isdigit() and ". " in x]
        return {"candidates": [{"content": {"parts": [{"text": "Here:\n" + json.dumps([{"name": n, "summary": f"does {n}"} for n in [*names, "stranger"]])}]}}]}


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


FAST = clients.Limits(6_000_000, 6_000_000_000)


def test_order_and_concurrency(service, monkeypatch):
    monkeypatch.setenv("LOOM_TEST_KEY", "secret")
    service.slow = 0.05
    texts = [f"text {i}" for i in range(1050)]
    client = clients.EmbeddingClient(service.url, "m", DIM, key_variable="LOOM_TEST_KEY", limits=FAST)
    assert client(texts) == connectors.HashEmbedder(DIM)(texts)
    assert service.keys == {"Bearer secret"} and 1 < service.most <= client.workers == 50 and len(service.seen) == 11
    service.most = 0
    assert client.shared(25)(texts) == connectors.HashEmbedder(DIM)(texts) and service.most <= 2
    assert client([]) == []


def test_asks_again(service):
    client = clients.EmbeddingClient(service.url, "m", DIM, limits=FAST, pause=0.01)
    service.refuse = [429, 503]
    assert client.one("a") == connectors.HashEmbedder(DIM).one("a")
    service.refuse = [429, 500, 429]
    with pytest.raises(clients.ServiceError, match="429"):
        client.one("b")
    service.refuse = [400, 200]
    with pytest.raises(clients.ServiceError, match="400"):
        client.one("c")
    assert sorted(service.seen.values()) == [1, 3, 3]


def test_wrong_replies(service, monkeypatch):
    client = clients.EmbeddingClient(service.url, "m", DIM, limits=FAST)
    with pytest.raises(ValueError, match="not 9"):
        clients.EmbeddingClient(service.url, "m", 9, limits=FAST).one("a")
    service.short = True
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        client(["a", "b"])
    monkeypatch.delenv("LOOM_NO_KEY", raising=False)
    with pytest.raises(ValueError, match="LOOM_NO_KEY"):
        clients.EmbeddingClient(service.url, "m", DIM, key_variable="LOOM_NO_KEY").one("a")
    with pytest.raises(clients.ServiceError, match="error 0"):
        clients.EmbeddingClient("http://127.0.0.1:9/", "m", DIM, pause=0.0).one("a")


def test_limits(service):
    assert clients.Limits.of({}) == clients.Limits(500, 150_000) == clients.Limits.of({clients.HEADERS[0]: "many"})
    client = clients.EmbeddingClient(service.url, "m", DIM).probed()
    assert client.limits == clients.Limits(7000, 90_000_000) and client.workers == 50
    slow = client._with(limits=clients.Limits(600, 90_000_000)).shared(2)  # a request each 0.2 s
    service.begins.clear()
    slow([f"t{i}" for i in range(301)])
    gaps = [b - a for a, b in zip(service.begins, service.begins[1:])]
    assert len(gaps) == 3 and min(gaps) > 0.15


def test_summaries(service):
    client = clients.SummaryClient(service.url, "m", limits=FAST)
    assert client.functions([{"name": "f", "body": "fn f() {}"}, {"name": "g", "body": "fn g() {}", "calls": {"f": "x"}}]) == [("f", "does f"), ("g", "does g")]
    assert client.entries([{"kind": "file", "path": "a/b.rs", "symbols": ["x"]}]) == [("a/b.rs", "does a/b.rs")]


def test_from_the_command_line(spark, service, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.rs").write_text("pub fn parse_it() { helper() }\nfn helper() {}\n")
    (root / "b.md").write_text("# Title\nwords here\n")

    def run(*args):
        out = io.StringIO()
        assert cli.main(["--root", str(root), "--index", str(tmp_path / "index"), *args], out) == 0
        return json.loads(out.getvalue())

    to = ("--service", service.url, "--model", "m")
    assert run("embed", "--dim", str(DIM), *to)["pending"] == 0
    index = Index(spark, str(tmp_path / "index"))
    assert index.store.manifest().model == "m" and index.embeddings.count() == index.chunks.count() == 4
    assert run("search", "parse", *to)["suggestion"] is None
    assert "no embedder" in run("search", "parse")["suggestion"]  # the service's vectors are no hashed features
    assert run("summarize", *to)["generated"] == 2
    said = {r.key: r.summary for r in index.table("summaries").collect()}
    assert said["helper"] == "does helper" and said["parse_it"] == "does parse_it" and said["file::.:a.rs"] == "does ./a.rs"
