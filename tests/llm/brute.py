"""Plain versions that the operators are held against on small inputs."""

import re
from collections import defaultdict


def jaccard_components(rows, words=3, percent=90):
    """rows: (doc_id, text). {doc_id: (n_shingles, component_id)} by comparing all sets that share a shingle."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                shared[j] += 1
            index[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def repeated_bytes(rows, length=400):
    """rows: (doc_id, bytes). [(doc_id, n_bytes, n_removed, n_spans, kept)]: every string of the length looked up by its content."""
    seen = defaultdict(int)
    for _, data in rows:
        for k in range(len(data) - length + 1):
            seen[hash(data[k : k + length])] += 1
    out = []
    for i, data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[hash(data[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out
