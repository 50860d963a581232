"""Plain-Python versions of the operators, written from their contracts."""

import hashlib
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, percent=85):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component_id, kept)}"""
    sets = {}
    for doc, text in docs:
        w = WORD.findall(lower(text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by = {}
    for doc, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(doc)
    common = {}
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def remove_repeats(docs, width=20):
    """docs: [(doc_id, text)] -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def ids_crc32(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def turns_digest(turns):
    """turns: [(role, text)] in order -> (n_turns, turns_sha256, loss_chars, loss_sha256)"""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def near_vectors(rows, threshold=0.93):
    """rows: [(vec_id, embedding, label)] -> {vec_id: (n_links, component_id)}"""
    import numpy as np

    usable = {}
    for v, e, label in rows:
        if label is not None and label == label and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float64)
            usable[v] = (label, x / np.linalg.norm(x))
    ids = sorted(usable)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= threshold:
                links.append((a, b))
    comp = components([v for v, _, _ in rows], links)
    n = dict.fromkeys(comp, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {v: (n[v], comp[v]) for v in comp}
