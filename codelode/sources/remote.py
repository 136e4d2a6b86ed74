"""What comes from outside the engine: pinned clones, indexer processes, artifact bundles, local embedding servers."""

from __future__ import annotations

import fcntl
import hashlib
import ipaddress
import json
import os
import re
import subprocess
import urllib.parse
import urllib.request
import uuid

MAX_RESPONSE = 16 << 20


def materialize(url: str, revision: str, cache: str) -> str:
    """A local clone at a 40-digit revision, made once under a lock; later calls find it. Returns its folder."""
    if not re.fullmatch(r"[0-9a-f]{40}", revision):
        raise ValueError("a revision is 40 hexadecimal digits")
    if url.startswith("-"):
        raise ValueError("a remote may not look like an option")
    folder = os.path.join(cache, hashlib.sha256(f"{url}\x1f{revision}".encode()).hexdigest())
    os.makedirs(cache, exist_ok=True)
    with open(f"{folder}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.isdir(folder):
            part = f"{folder}.{uuid.uuid4().hex}"
            subprocess.run(["git", "clone", "-q", "--no-checkout", "--", url, part], check=True, capture_output=True)
            subprocess.run(["git", "-C", part, "checkout", "-q", "--detach", revision], check=True, capture_output=True)
            os.rename(part, folder)
    return folder


def run_indexer(command: list[str], root: str, output: str, publish: str, timeout: float) -> str:
    """Run an indexer in root and move its output file to publish when it ended well in time; raises otherwise and leaves nothing there."""
    subprocess.run(command, cwd=root, check=True, timeout=timeout, capture_output=True)
    made = os.path.join(root, output)
    if os.path.islink(made) or not os.path.isfile(made):
        raise FileNotFoundError(f"the indexer left no {output}")
    os.makedirs(os.path.dirname(publish), exist_ok=True)
    os.replace(made, publish)
    return publish


def accept_bundle(folder: str) -> dict:
    """The manifest of an artifact bundle (manifest.json with payload, size, sha256 and network) whose payload is whole and was made without a network."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    name = manifest["payload"]
    if os.path.basename(name) != name or name in ("", ".", ".."):
        raise ValueError("a payload is a file of its bundle")
    path = os.path.join(folder, name)
    if manifest.get("network") != "DENIED":
        raise ValueError("the bundle was made with a network")
    if os.path.islink(path) or os.path.getsize(path) != manifest["size"]:
        raise ValueError("the payload's size differs")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    if digest.hexdigest() != manifest["sha256"]:
        raise ValueError("the payload's hash differs")
    return manifest


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def embed_locally(endpoint: str, model: str, text: str, dims: int, timeout: float = 30.0) -> list[float]:
    """A text's vector from an embedding server on this machine (POST /api/embed). Only loopback addresses, no redirects, bounded answers."""
    host = urllib.parse.urlparse(endpoint).hostname or ""
    if host != "localhost" and not ipaddress.ip_address(host).is_loopback:
        raise ValueError("an embedding server must be on this machine")
    request = urllib.request.Request(endpoint.rstrip("/") + "/api/embed", json.dumps({"model": model, "input": text}).encode(), {"Content-Type": "application/json"})
    with urllib.request.build_opener(_NoRedirect, urllib.request.ProxyHandler({})).open(request, timeout=timeout) as answer:
        body = answer.read(MAX_RESPONSE + 1)
    if len(body) > MAX_RESPONSE:
        raise ValueError("the answer is too long")
    vector = [float(x) for x in json.loads(body)["embeddings"][0]]
    if len(vector) != dims or not all(abs(x) < float("inf") for x in vector):
        raise ValueError("the vector has other dimensions or isn't finite")
    return vector
