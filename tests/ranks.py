"""A tiny byte-pair rank file for tests."""

import base64

PATTERN = r" ?\w+| ?[^\s\w]+|\s+"
MERGES = [b"th", b"the", b" the", b"on", b"en", b"er", b" o", b" of"]


def write_ranks(folder) -> str:
    path = folder / "tiny.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + MERGES
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)
