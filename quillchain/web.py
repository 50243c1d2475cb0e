"""A local HTTP interface: generate at once, build as one background job at a time."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .errors import QuillError
from .operators.generate import Generator
from .sources.store import BuildConfig, Model, build_model

MOST_BYTES = 1 << 16
PAGE = """<!doctype html><meta charset=utf-8><title>quillchain</title>
<h2>Generate</h2>
<form id=f><input name=prompt placeholder=Prompt><input name=length type=number value=20><input name=temperature value=0.6><input name=seed placeholder=Seed><select name=mode><option>word<option>char</select><button>Generate</button></form><pre id=o></pre>
<h2>Build</h2>
<form id=b><input name=input placeholder="Folder of .txt files" required><input name=db placeholder="Model folder"><input name=order type=number min=1 value=2><select name=mode><option>word<option>char<option>both</select><label><input name=overwrite type=checkbox>overwrite</label><button>Build</button></form><pre id=s></pre>
<script>
const post=async(path,body)=>(await fetch(path,{method:'POST',body:JSON.stringify(body)})).json();
f.onsubmit=async e=>{e.preventDefault();const j=await post('/api/generate',Object.fromEntries(new FormData(f)));o.textContent=j.text??j.error};
b.onsubmit=async e=>{e.preventDefault();const d=Object.fromEntries(new FormData(b));d.overwrite=b.overwrite.checked;const j=await post('/api/build',d);s.textContent=j.error??'started';if(!j.error)watch()};
const watch=async()=>{const j=await(await fetch('/api/status')).json();s.textContent=j.state+' '+j.message;if(j.state=='running')setTimeout(watch,1000)};
watch()
</script>"""


class Service:
    """Job state and the open model, shared by request threads."""

    def __init__(self, spark, model_path: str):
        self.spark, self.model_path, self.lock, self.model = spark, model_path, threading.Lock(), None
        self.status = {"state": "idle", "message": ""}

    def generate(self, asked: dict) -> dict:
        with self.lock:  # one open model, dropped after a rebuild
            path = str(asked.get("db") or self.model_path)
            if self.model is None or self.model.path != path.rstrip("/"):
                self.model = Model(self.spark, path)
            walk = Generator(self.model, int(asked["seed"]) if asked.get("seed") not in (None, "") else None)
            return {"text": walk.generate(str(asked.get("mode", "word")), str(asked.get("prompt", "")), int(asked.get("length", 20)), float(asked.get("temperature", 0.8)))}

    def build(self, asked: dict) -> dict:
        config = BuildConfig(str(asked["input"]), str(asked.get("db") or self.model_path), int(asked.get("order", 2)), str(asked.get("mode", "word")), "replace", asked.get("overwrite") is True)
        config.check()
        with self.lock:
            if self.status["state"] == "running":
                raise ValueError("a build is running")
            self.status = {"state": "running", "message": "started"}
        threading.Thread(target=self._build, args=(config,), daemon=True).start()
        return dict(self.status)

    def _build(self, config: BuildConfig) -> None:
        def tell(phase: str, done: int, of: int, message: str) -> None:
            self.status = {"state": "running", "phase": phase, "done": done, "of": of, "message": f"{phase} {done}/{of} {message}"}

        try:
            done = {"state": "done", "message": str(build_model(self.spark, config, tell).transition_rows)}
        except Exception as bad:  # noqa: BLE001  whatever ends the job is its result
            done = {"state": "error", "message": str(bad)}
        with self.lock:
            self.model, self.status = None, done


def server(spark, model_path: str, port: int = 0) -> ThreadingHTTPServer:
    service = Service(spark, model_path)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def answer(self, code: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def say(self, code: int, what: dict) -> None:
            self.answer(code, json.dumps(what, ensure_ascii=False).encode())

        def do_GET(self) -> None:
            if self.path == "/":
                self.answer(200, PAGE.encode(), "text/html")
            elif self.path == "/api/status":
                self.say(200, service.status)
            else:
                self.say(404, {"error": "not found"})

        def do_POST(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BYTES:
                    raise ValueError("the request is too large")
                asked = json.loads(self.rfile.read(size) or b"{}")
                if self.path == "/api/generate":
                    self.say(200, service.generate(asked))
                elif self.path == "/api/build":
                    self.say(202, service.build(asked))
                elif self.path == "/api/shutdown":
                    self.say(200, {"state": "stopping"})
                    threading.Thread(target=self.server.shutdown, daemon=True).start()
                else:
                    self.say(404, {"error": "not found"})
            except (QuillError, ValueError, KeyError, TypeError) as bad:
                self.say(400, {"error": str(bad)})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(spark, model_path: str, port: int = 0) -> None:
    made = server(spark, model_path, port)
    print(f"http://127.0.0.1:{made.server_address[1]}/", flush=True)
    made.serve_forever()
