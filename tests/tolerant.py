"""A plain recursive reader of tolerant JSON, for comparison in tests."""

import re

_BLANK = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ATOM = re.compile(r"[^\s,\]}]+")
_ESC = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class Broken(ValueError):
    pass


def _skip(s, i):
    return _BLANK.match(s, i).end()


def _string(s, i):
    q, out = s[i], []
    i += 1
    while True:
        if i >= len(s):
            raise Broken
        c = s[i]
        if c == q:
            return "".join(out), i + 1
        if c == "\\":
            e = s[i + 1] if i + 1 < len(s) else ""
            if e == "u":
                out.append(chr(int(s[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESC.get(e, e))
            i += 2
            continue
        out.append(c)
        i += 1


def value(s, i):
    i = _skip(s, i)
    if i >= len(s):
        raise Broken
    if s[i] in "\"'":
        return _string(s, i)
    if s[i] == "{":
        out, i = {}, _skip(s, i + 1)
        while True:
            if i >= len(s):
                raise Broken
            if s[i] == "}":
                return out, i + 1
            if s[i] in "\"'":
                k, i = _string(s, i)
            elif m := _NAME.match(s, i):
                k, i = m.group(), m.end()
            else:
                raise Broken
            i = _skip(s, i)
            if s[i : i + 1] != ":":
                raise Broken
            out[k], i = value(s, i + 1)
            i = _skip(s, i)
            if s[i : i + 1] == ",":
                i = _skip(s, i + 1)
            elif s[i : i + 1] != "}":
                raise Broken
    if s[i] == "[":
        out, i = [], _skip(s, i + 1)
        while True:
            if i >= len(s):
                raise Broken
            if s[i] == "]":
                return out, i + 1
            v, i = value(s, i)
            out.append(v)
            i = _skip(s, i)
            if s[i : i + 1] == ",":
                i = _skip(s, i + 1)
            elif s[i : i + 1] != "]":
                raise Broken
    m = _ATOM.match(s, i)
    if not m:
        raise Broken
    a = m.group()
    if a in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[a], m.end()
    try:
        return float(a), m.end()
    except ValueError:
        raise Broken from None


def payload(text):
    """The object of a payload, or None."""
    if text is None:
        return None
    t = text.strip().strip("﻿").strip()
    try:
        while t.startswith('"'):
            t = value(t, 0)[0].strip()
        return value(t, t.index("{"))[0]
    except (Broken, ValueError, IndexError):
        return None


def found(text):
    """(owner, owner_id, path) of the objects with a member ``value`` in a payload."""
    root, out = payload(text), set()

    def opened(x):
        while isinstance(x, str) and x.strip()[:1] in ("{", "[", '"'):
            try:
                y, end = value(x.strip(), 0)
            except Broken:
                return x
            if end != len(x.strip()) or not isinstance(y, (dict, list, str)):
                return x
            x = y
        return x

    def walk(x, path, owner, oid):
        x = opened(x)
        if isinstance(x, dict):
            if path and "value" in x:
                out.add((owner, oid, "/".join(path)))
            for k, v in x.items():
                walk(v, [*path, k], owner, oid)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(v, [*path, str(k)], owner, oid)

    if isinstance(root, dict):
        secs = [root] if "nodes" in root or "edges" in root else [opened(root.get(s)) for s in ("catgraph_tree", "synthesis", "testing", "characterization")]
        for sec in secs:
            if isinstance(sec, dict):
                for k, owner in (("nodes", "node"), ("edges", "edge")):
                    for x in opened(sec.get(k)) or []:
                        x = opened(x)
                        if isinstance(x, dict):
                            walk(x, [], owner, x.get("id"))
    return out
