"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed_bytes(rows: list[tuple[int, str | None]], length: int) -> dict[int, np.ndarray]:
    """Mask of the removed bytes of each document."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mask = np.zeros(len(data), bool)
        for start in range(len(data) - length + 1):
            string = data[start:start + length]
            if string in seen:
                mask[start:start + length] = True
            seen.add(string)
        out[doc] = mask
    return out


def repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    """``(n_bytes, n_removed, n_spans, sha256 of what is kept)`` of each document."""
    out, texts = {}, dict(rows)
    for doc, mask in removed_bytes(rows, length).items():
        data = (texts[doc] or "").encode()
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(mask) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        out[doc] = (len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text: str | None, n: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def components(rows: list[tuple[int, str | None]], n: int, p: int, q: int) -> dict[int, tuple[int, int]]:
    """``(set size, smallest id reachable)`` of each document; linked from a similarity of p / q on."""
    sets = {doc: shingle_set(text, n) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and q * both >= p * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), top(doc)) for doc in ids}


def drop_lines(rows: list[tuple], ratio: float, least: int) -> list[str | None]:
    """Cleaned texts of rows ``(host, text)``."""
    pages: dict[str, list[set[str]]] = {}
    for host, text in rows:
        if host is not None:
            pages.setdefault(host, []).append(set((text or "").split("\n")) if text is not None else set())
    bad = {host: {x for x in set().union(*sets) if sum(x in s for s in sets) > ratio * len(sets)
                  and sum(x in s for s in sets) >= least} for host, sets in pages.items()}
    return [None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or x not in bad.get(h, ()))
            for h, t in rows]


def license_runs(text: str, templates: list[tuple[int, str, list[str]]], threshold: float) -> tuple[float, str | None, int]:
    """``(score, license, n_matches)`` of a text none of whose lines or paragraphs matches: every run is measured."""
    words = re.findall("[a-z0-9]+", text.translate(LOWER))
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for n, name, own in templates:
        for i in range(len(grams)):
            best = None
            for j in range(i + 1, min(len(grams), i + int((2 - threshold) / threshold * len(own) + 1e-9)) + 1):
                run = set(grams[i:j])
                score = 2.0 * len(run & set(own)) / (len(run) + len(own))
                if score >= threshold and grams[i] in own and grams[j - 1] in own:
                    best = max(best or (0, 0), (score, j - i))
            if best:
                found.append((i, -best[0], -best[1], n, name))
    end, count = -1, 0
    for i, _, length, *_ in sorted(found):
        if i > end:
            end, count = i - length, count + 1
    _, _, _, _, name = min(found, key=lambda f: (f[1], f[3]), default=(0, 0, 0, 0, None))
    return -min((f[1] for f in found), default=0.0), name, count


def vector_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    """``(id, label, indexes, error)`` of rows ``(id, vector, label)``, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    starts = {}
    for i, v, _ in kept:
        if i is not None:
            starts[i] = min(v, starts.get(i, v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[starts[i][p * width:(p + 1) * width] for i in sorted(starts)[:entries]] for p in range(parts)]

    def nearest(part: list[int], book: list[list[int]]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for row in cut:
                members[nearest(row[p], book)[1]].append(row[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else entry
                        for e, entry in enumerate(book)]
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    return [(i, label, [e for _, e in f], sum(d for d, _ in f)) for (i, _, label), f in zip(kept, found)]


def prefix_nodes(rows: list[tuple], block: int) -> list[tuple]:
    """The nodes of rebuilt conversations, from all prefixes as tuples."""
    convs, members, ends, kids = (defaultdict(list) for _ in range(4))
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())
            convs[conv].append((order, (role, text)))
    turns = {c: [t for _, t in sorted(found, key=lambda x: x[0])] for c, found in convs.items()}
    for conv, own in turns.items():
        shared = zlib.crc32(str(conv).encode()) % 6
        path = tuple(turns.get(conv - int(math.fmod(conv, block)), [])[:shared] + own[shared:])
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
        ends[path].append(conv)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        if path:
            kids[path[:-1]].append(path)
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                    len(kids[path]), leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)
