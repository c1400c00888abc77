"""Plain statements of what the operators do, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def simhash(docs):
    fp = {}
    for k, t in docs:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        fp[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {k: k for k in fp}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = list(fp)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {(k, f"{fp[k]:016x}", find(k)) for k in fp}


def words_dedup(docs, n=20):
    seen, out = set(), set()
    for k, t in sorted(docs, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            if x in seen:
                gone.update(range(i, i + n))
            seen.add(x)
        out.add((k, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def bytes_dedup(docs, n=200):
    count = defaultdict(int)
    texts = [(k, (t or "").encode()) for k, t in docs]
    for _, t in texts:
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] += 1
    out = set()
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.add((k, len(t), sum(gone), spans, sha(bytes(x for x, g in zip(t, gone) if not g))))
    return out


def trie(rows, base=lambda c: c - int(c / 100) * 100, shared=lambda c: zlib.crc32(str(c).encode()) % 6):
    """Rows (conv_id, turn, role, text) to the trie's rows; no bands, no hashes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    whole = {c: own.get(c - base(c), [])[: shared(c)] + t[shared(c) :] for c, t in own.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in children
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1]) if x else 0
    ends = lambda x: sha(",".join(map(str, sorted(c for c in members[x] if len(whole[c]) == len(x)))).encode())
    return {(min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children[x]), leaves[x], saved[x], ends(x)) for x, m in members.items()}


def spelling(docs, damage=97, shortest=5, least=3, ratio=2):
    n = defaultdict(int)
    for k, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= shortest
    n = {w: c for w, c in n.items() if c >= least}

    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}
