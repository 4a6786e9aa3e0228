"""Plain versions of what the operators compute, for small tables."""

import re

import duckdb
import numpy as np
import xxhash

from flowloom.llm import sql
from flowloom.llm.secret_scan import BASE


def fingerprint(text, words=3):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), 42) for i in range(n)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > n)


def components(fps, bits=3):
    """For each fingerprint the index of the first one that it can reach."""
    a = np.array(fps, np.uint64)
    label = np.arange(len(a))
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= bits) for x in a]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def similar_texts(texts):
    """For each text the index of the first one that similar pairs reach."""
    def words(text):
        found = (text or "").lower().split()
        return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = [words(t) for t in texts]
    label = list(range(len(sets)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def base_secrets(text):
    found = []
    keyword = r"(password|passwd|secret|token|api_?key)"
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for m in re.finditer(keyword + r"[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", folded):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{BASE[k].kind}:{s}:{e}" for s, k, e in sorted(found))


def ask(query, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(query).df()


def pipeline(documents, labels, benchmark):
    """The rows of all five stages, from the operators' SQL and all pairs of shingle sets."""
    kept = ask(sql.QUALITY, documents=documents, labels=labels)
    docs = documents[documents.doc_id.isin(kept[kept.kept].doc_id)].reset_index(drop=True)
    cut = ask(sql.LINE_DEDUP, documents=docs).set_index("doc_id").loc[docs.doc_id]
    changed = (cut.n_removed > 0).to_numpy()
    docs["text"] = cut.text.to_numpy()
    docs["n_chars"] = np.where(changed, docs.text.str.len(), docs.n_chars)
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    label = np.array(similar_texts(docs.text))
    docs = docs[label == np.arange(len(docs))].reset_index(drop=True)
    found = ask(sql.DECONTAMINATE, documents=docs, benchmark=benchmark)
    docs = docs[~docs.doc_id.isin(found[found.contaminated].doc_id)].reset_index(drop=True)
    mixed = ask(sql.MIXING.replace("* size)::bigint as taken", ")::bigint as taken"), documents=docs)
    copies = mixed.set_index("doc_id").taken.loc[docs.doc_id].to_numpy()
    return docs.loc[np.repeat(docs.index, copies)].reset_index(drop=True)
