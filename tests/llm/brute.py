"""Plain Python statements of what the queries must return."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ["assign", "access", "hex"]


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    n = Counter(k for _, k, _ in out)
    return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), base


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_groups(docs, width=3, percent=85):
    """doc_id -> (set size, component, kept) by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judge(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = lower(host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def conversation(turns):
    """turns in order: (n, digest of turns, loss chars, digest of loss)."""
    learned = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def neighbours(ids, vectors, queries, k=5):
    """query -> [(vec_id, score)], nearest first, by all cosines."""
    m = np.array(vectors, float)
    norm = np.sqrt((m * m).sum(1))
    out = {}
    for q in queries:
        i = ids.index(q)
        s = (m * m[i]).sum(1) / (norm * norm[i])
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))
        out[q] = [(ids[j], s[j]) for j in order[:k]]
    return out


def edits(item, words):
    """Least word edits between item and any stretch of words, by the quadratic recurrence."""
    last = list(range(len(item) + 1))
    best = last[-1]
    for w in words:
        now = [0]
        for i, x in enumerate(item):
            now.append(min(last[i] + (x != w), last[i + 1] + 1, now[i] + 1))
        last, best = now, min(best, now[-1])
    return best


def token_pieces(texts):
    """doc -> its ids with the end id, by the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts}


def check_packing(rows, tokens, limit=2048):
    """Every id lies in one piece; pieces and sequences are gapless; returns the share of padding."""
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = tokens[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert r["length"] > 0 and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in tokens.items()}
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values(), default=0) <= limit
    padding = sum(limit - n for n in filled.values() if n & (n - 1))
    return padding / max(1, sum(filled.values())), filled


def redacted(text):
    """Every stretch covered by overlapping base spans replaced by the mark."""
    spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in secrets(text)[4].split(",") if s))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out, at = out + text[at:a] + "[SECRET]", b
        at = max(at, b)
    return out + text[at:]
