"""Brute-force versions shared by the tests of the operators and the pipeline."""

import collections
import hashlib
import re

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated_by_hand(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = WORD.findall(low(text))
        if item is not None and words:
            for k in range(max(1, len(words) - 9)):
                windows[tuple(words[k : k + 10])].add(item)
    out = []
    for doc, text in docs:
        words, hit, met = WORD.findall(low(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    met |= windows[tuple(words[k : k + size])]
        out.append((doc, len(words), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit)))
    return collections.Counter(out)


def passages_by_hand(rows):
    """Lines left of each row: a line goes with a pair of lines that stood before."""
    ordered = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash_of(r[1])))
    first, left = {}, {}
    for at, (i, t) in enumerate(ordered):
        own = (t or "").split("\n")
        full = [k for k, line in enumerate(own) if line.strip(" \t\r")]
        gone = set()
        for a, b in zip(full, full[1:]):
            d, upto = first.setdefault(tuple(own[a : b + 1]), (at, b))
            if d != at or a > upto:
                gone.update(range(a, b + 1))
        left[(i, t)] = [line for k, line in enumerate(own) if k not in gone]
    return [left[r] for r in rows]


def xxhash_of(text):
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return 42 if text is None else h - (1 << 64) * (h >> 63)


def fingerprint_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_by_hand(rows):
    marks = [fingerprint_by_hand(t) for _, t in rows]
    own = sorted(set(marks))
    root = {m: m for m in own}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a in own:
        for b in own:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    lowest = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            lowest[find(m)] = min(i, lowest.get(find(m), i))
    return collections.Counter((i, f"{m:016x}", lowest.get(find(m))) for (i, _), m in zip(rows, marks))
