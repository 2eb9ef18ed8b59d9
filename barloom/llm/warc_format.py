"""WARC records: making them, and reading archives that may be damaged. No Spark in here."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(re.escape(GZIP) + b"|" + re.escape(VERSION))


#: A member that inflates to more is quarantined: it would not fit a row.
MOST_INFLATED = (1 << 31) - 1


class Found(NamedTuple):
    """A record (reason is null) or a quarantined gap. Offsets and lengths are bytes of the archive;
    of records that share a gzip member, the member's."""

    offset: int
    length: int
    reason: str | None
    headers: dict[str, str]
    block: bytes


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own. Line ends within header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    data = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, wbits=31)
    return squeeze.compress(data) + squeeze.flush()


def _parse(data, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, block) of the plain record at a position; ValueError with what fails."""
    if bytes(data[at : at + 7]) != VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    lines = data[at:end].split(b"\r\n")[1:]
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if "warc-record-id" not in headers or "warc-type" not in headers:
        raise ValueError("a mandatory header is missing")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block does not end at its length")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:].lower() != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return stop + 4, headers, block


def _member(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """(end, what it holds, what fails) of the gzip member at a position."""
    view, inflate, out, pos, size = memoryview(data), zlib.decompressobj(wbits=31), [], at, 0
    try:
        while pos < len(data) and not inflate.eof:
            part = view[pos : pos + 65536]
            out.append(inflate.decompress(part))
            pos += len(part) - len(inflate.unused_data)
            size += len(out[-1])
            if size > MOST_INFLATED:
                return pos, b"".join(out), "gzip member inflates beyond a row"
    except zlib.error as e:
        return pos, b"".join(out), f"gzip: {e}"
    return pos, b"".join(out), None if inflate.eof else "gzip member is cut off"


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, plain or of gzip members, in order. Where a check fails, the next
    member or version line that starts a valid record is searched, and the bytes passed over come
    out as one gap. Records that a damaged member still yields whole come before its gap; where its bytes
    also hold them as they are (stored blocks), they are not found again."""
    at, bad, why = 0, None, ""
    seen: list[tuple] = []  # of the damaged members that reach furthest
    until = 0
    while at < len(data):
        found: list[Found] = []
        end, reason = at, None
        if data[at : at + 3] == GZIP:
            end, inner, reason = _member(data, at)
            parts = list(salvage(inner)) if inner[:7] == VERSION else []
            if reason:
                found = [Found(at, end - at, None, p.headers, p.block) for p in parts if p.reason is None]
                yield from found
                if at >= until:
                    seen = []
                seen += [(f.headers, f.block) for f in found]
                until = max(until, end)
            elif parts:
                found = [p._replace(offset=at, length=end - at) for p in parts]
            else:
                reason = "member holds no record"
        else:
            try:
                end, headers, block = _parse(data, at)
                if at < until and (headers, block) in seen:
                    at = end
                    continue
                found = [Found(at, end - at, None, headers, block)]
            except ValueError as e:
                reason = str(e)
        if reason is None:
            if bad is not None:
                yield Found(bad, at - bad, why, {}, b"")
                bad = None
            yield from found
            at = end
            continue
        if bad is None:
            bad, why = at, reason
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None:
        yield Found(bad, len(data) - bad, why, {}, b"")
