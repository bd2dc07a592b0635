"""Reading from and adding to an IPFS node over HTTP."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from dataclasses import dataclass


@dataclass(frozen=True)
class IpfsStore:
    """gateway: where content is read. rpc: the node's API, needed to add and publish. key: name to publish under."""

    gateway: str
    rpc: str | None = None
    key: str | None = None
    timeout: float = 10.0

    @property
    def mode(self) -> str:
        """read, add or publish, by what is configured."""
        return "read" if not self.rpc else "publish" if self.key else "add"

    def _ask(self, path: str, method: str = "GET", headers: dict | None = None):
        """Try the content address, then the name; FileNotFoundError if neither answers."""
        for space in ("ipfs", "ipns"):
            request = urllib.request.Request(f"{self.gateway.rstrip('/')}/{space}/{urllib.parse.quote(path.lstrip('/'))}", headers=headers or {}, method=method)
            try:
                return urllib.request.urlopen(request, timeout=self.timeout)  # noqa: S310
            except urllib.error.HTTPError as e:
                e.close()
        raise FileNotFoundError(path)

    def get(self, path: str) -> bytes:
        with self._ask(path) as answer:
            return answer.read()

    def get_range(self, path: str, start: int, end: int) -> bytes:
        """Bytes [start, end); an empty range gives none without asking."""
        if end <= start:
            return b""
        with self._ask(path, headers={"Range": f"bytes={start}-{end - 1}"}) as answer:
            body = answer.read()
            return body if answer.status == 206 else body[start:end]

    def size(self, path: str) -> int:
        """Length by header; 0 if the gateway does not tell."""
        with self._ask(path, "HEAD") as answer:
            return int(answer.headers.get("content-length") or 0)

    def resolve(self, name: str) -> str | None:
        """The content address behind a published name, as the gateway tells it."""
        request = urllib.request.Request(f"{self.gateway.rstrip('/')}/ipns/{urllib.parse.quote(name)}", method="HEAD")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                roots = answer.headers.get("x-ipfs-roots")
                return roots.split(",")[-1].strip() if roots else None
        except urllib.error.HTTPError as e:
            e.close()
            return None

    def _call(self, name: str, body: bytes = b"", headers: dict | None = None, **args: str) -> list[dict]:
        if not self.rpc:
            raise ValueError(f"{name} needs an RPC URL")
        url = f"{self.rpc.rstrip('/')}/api/v0/{name}?{urllib.parse.urlencode(args)}"
        with urllib.request.urlopen(urllib.request.Request(url, body, headers or {}, method="POST"), timeout=self.timeout) as answer:  # noqa: S310
            return [json.loads(line) for line in answer.read().splitlines() if line.strip()]

    def add(self, name: str, content: bytes, pin: bool = True) -> str:
        """Add a file (slashes of its name become dashes) and return its address."""
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name.replace("/", "-")}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
        return self._call("add", body, {"content-type": f"multipart/form-data; boundary={mark}"}, pin=str(pin).lower())[-1]["Hash"]

    def keys(self) -> dict[str, str]:
        """Names and ids of the node's keys."""
        return {k["Name"]: k["Id"] for k in self._call("key/list")[0]["Keys"]}

    def create_key(self, name: str) -> str:
        return self._call("key/gen", arg=name)[0]["Id"]

    def publish(self, address: str) -> str:
        """Publish an address under the store's key, which must exist."""
        if not self.key or self.key not in self.keys():
            raise ValueError("the store has no such key to publish under")
        return self._call("name/publish", arg=f"/ipfs/{address}", key=self.key)[0]["Name"]
