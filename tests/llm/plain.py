"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(rows):
    """Fingerprint and group number of each (doc_id, text)."""
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    links = [(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)]
    return fps.tolist(), components(len(rows), links)


def line_dedup(rows, min_chars=20, min_docs=3):
    """n_lines, n_dropped and kept text of each (doc_id, text)."""
    least = -(2**63)
    key = lambda line: low(line.strip(BLANKS))
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(least if doc is None else doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if keeper.get(key(x), doc if doc is not None else least) == (doc if doc is not None else least)]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rule_counts(text):
    w = words(text)
    n = len(w)
    windows = [tuple(w[i : i + 8]) for i in range(n - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines, before, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in before
        before.add(x)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, w)), symbols, dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def check_pieces(docs, pieces, encode, end=1, window=2048):
    """docs: rows of (doc_id, text), ids distinct; pieces: the columns of the packing query."""
    ids = {d: np.array([*encode(t or ""), end], "<u4") for d, t in docs}
    at, seen = 0, Counter()
    for doc, start, length, crc, n, sequence, offset in sorted(pieces, key=lambda r: (r[5], r[6])):
        assert sequence * window + offset == at and offset + length <= window
        assert start == seen[doc] and n == len(ids[doc])
        assert crc == zlib.crc32(ids[doc][start : start + length].tobytes())
        at += length
        seen[doc] += length
    assert seen == Counter({d: len(x) for d, x in ids.items()})
