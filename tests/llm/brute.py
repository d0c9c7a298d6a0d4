"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def token_rows(rows, path):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(path), 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        yield doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)


def url(text, rules):
    host = path = ""
    if text is not None and "://" in text:
        m = re.match(r"([^/?#]*)([^?#]*)", text.split("://", 1)[1], re.S)
        host, path = m[1].translate(LOWER), m[2]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items):
    windows = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        if w and item is not None:
            n = min(10, len(w))
            windows.setdefault(str(item), set()).update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    for doc_id, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, grams in windows.items():
            for n in {len(g) for g in grams}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i:i + n]) in grams:
                        hit.update(range(i, i + n))
                        found.add(item)
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    out = [("assign", 0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", 1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", 2, m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{m.start()}:{m.end()}" for k, o, m in sorted(out, key=lambda x: (x[2].start(), x[1]))], [sum(k == kind for k, _, _ in out) for kind in ("assign", "access", "hex")]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out], [sum(k == kind for k, _ in out) for kind in ("email", "ip", "card", "phone")]


def gram_set(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def similar(rows, threshold=85):
    sets = [(d, gram_set(t)) for d, t in rows]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for h in holders.values() if len(h) > 1 for p in combinations(h, 2)}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= threshold * len(a | b):
            top[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


def warc(rows, least=1000):
    seen = {}
    for page_id, html in rows:
        p = (html or "").encode()
        seen[p] = max(seen.get(p, page_id), page_id)
    for page_id, html in rows:
        p = (html or "").encode()
        other = len(p) >= least and seen[p] != page_id
        yield page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", seen[p] if other else None


def copies(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    for doc_id, text in rows:
        t = (text or "").translate(LOWER)
        yield doc_id, max(groups[t]), len(groups[t]), max(groups[t]) == doc_id, hashlib.sha256(t.encode()).hexdigest()


def jump(key, shards):
    """The published loop, on whole numbers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def periodic_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_rows(rows, rebuild=True):
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if rebuild and doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = periodic_runs(w)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        yield (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
               hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
               hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def turn_name(role, text):
    """The two hashes that order turns of one number, as signed 64-bit numbers."""
    import xxhash

    out = []
    for k in (1, 2):
        h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)
        for part in (role, text):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def trie(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_name(role or "", text or ""), role or "", text or ""))
    own = {c: [r[3:] for r in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(c - c % 20, [])[:h] + t[h:]
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, ())) or 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids.get(p, ()))
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(p))
        yield (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
