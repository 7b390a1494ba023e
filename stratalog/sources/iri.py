"""References against a base, after RFC 3986 section 5."""
from __future__ import annotations

import re

_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z", re.S)
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
BAD = re.compile('[\x00-\x20<>"{}|^`\\\\]')


def without_dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "..":
            if len(out) > 1 or (out and out[0] != ""):
                out.pop()
            if last:
                out.append("")
        elif s == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out)


def resolve(ref: str, base: str | None) -> str:
    if not base:
        return ref
    scheme, host, path, query, frag = _PARTS.match(ref).groups()
    bs, bh, bp, bq, _ = _PARTS.match(base).groups()
    if scheme is not None:
        path = without_dots(path) if host is not None or path.startswith("/") else path
    else:
        scheme = bs
        if host is not None:
            path = without_dots(path)
        else:
            host = bh
            if not path:
                path = bp
                query = bq if query is None else query
            elif path.startswith("/"):
                path = without_dots(path)
            else:
                path = without_dots("/" + path if bh is not None and not bp else bp[: bp.rfind("/") + 1] + path)
    out = (scheme + ":" if scheme else "") + ("//" + host if host is not None else "") + path
    return out + ("?" + query if query is not None else "") + ("#" + frag if frag is not None else "")
