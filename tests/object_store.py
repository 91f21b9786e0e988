"""An object store for tests: the part of the S3 protocol that a client needs to list and read, over a dict of objects."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit
from xml.sax.saxutils import escape

TIME = "2001-09-09T01:46:40.000Z"


@contextmanager
def served(bucket: str, objects: dict[str, bytes]):
    """Gives the root of the bucket as a URI."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_):
            pass

        def _answer(self, status: int, body: bytes = b"", length: int | None = None, **headers: str) -> None:
            self.send_response(status)
            self.send_header("Content-Length", str(len(body) if length is None else length))
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        def do_HEAD(self):
            key = unquote(urlsplit(self.path).path).removeprefix(f"/{bucket}").removeprefix("/")
            if key and key not in objects:
                return self._answer(404)
            self._answer(200, length=len(objects.get(key, b"")), Last_Modified="Sun, 09 Sep 2001 01:46:40 GMT", ETag='"x"')

        def do_GET(self):
            url = urlsplit(self.path)
            key, asked = unquote(url.path).removeprefix(f"/{bucket}").removeprefix("/"), parse_qs(url.query, keep_blank_values=True)
            if "list-type" in asked:
                return self._answer(200, self._listing(asked.get("prefix", [""])[0], asked.get("delimiter", [""])[0]).encode(), Content_Type="application/xml")
            if key not in objects:
                return self._answer(404)
            body, span = objects[key], self.headers.get("Range")
            if span:
                first, last = span.removeprefix("bytes=").split("-")
                part = body[int(first) : int(last) + 1 if last else None]
                return self._answer(206, part, Content_Range=f"bytes {first}-{int(first) + len(part) - 1}/{len(body)}", ETag='"x"')
            self._answer(200, body, ETag='"x"')

        def _listing(self, prefix: str, delimiter: str) -> str:
            files, folders = [], set()
            for key, body in sorted(objects.items()):
                if key.startswith(prefix):
                    head, found, _ = key[len(prefix) :].partition(delimiter) if delimiter else (key, "", "")
                    if found:
                        folders.add(prefix + head + delimiter)
                    else:
                        files.append(f"<Contents><Key>{escape(key)}</Key><LastModified>{TIME}</LastModified><ETag>x</ETag><Size>{len(body)}</Size><StorageClass>STANDARD</StorageClass></Contents>")
            below = "".join(f"<CommonPrefixes><Prefix>{escape(f)}</Prefix></CommonPrefixes>" for f in sorted(folders))
            head = f"<Name>{bucket}</Name><Prefix>{escape(prefix)}</Prefix><KeyCount>{len(files) + len(folders)}</KeyCount><MaxKeys>1000</MaxKeys><IsTruncated>false</IsTruncated>"
            return f'<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{head}{"".join(files)}{below}</ListBucketResult>'

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"s3://key:secret@{bucket}?endpoint_override=127.0.0.1:{server.server_address[1]}&scheme=http&region=us-east-1"
    finally:
        server.shutdown()
        server.server_close()
