"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np

SPACE = "[\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_components(rows, size, percent):
    """``[(id, text)]`` -> ``{row number: (set size, smallest linked id)}``."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(SPACE, lower(text)) if x]
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[top(x)] = top(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[top(x)].append(i)
    return {x: (len(sets[x]), min((i for i in least[top(x)] if i is not None), default=None)) for x in range(len(rows))}


def substring_digest(texts, width):
    """``[text]`` -> ``[(bytes, removed, spans, sha256 of the rest)]``."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for s in range(len(b) - width + 1):
            seen[b[s:s + width]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, np.int8)
        for s in range(len(b) - width + 1):
            if seen[b[s:s + width]] > 1:
                gone[1 + s:1 + s + width] = 1
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def kept_lines(texts, tokens_of, order, lead, min_tokens, min_docs, similar):
    """``{id: text}`` -> ``{id: remaining text}``; ``order`` breaks ties of equally frequent lines."""
    leaves = defaultdict(lambda: defaultdict(list))
    for i, t in texts.items():
        for no, line in enumerate((t or "").split("\n")):
            tokens = tokens_of(line.encode())
            if len(tokens) >= min_tokens:
                leaves[len(tokens), tuple(tokens[:lead])][tuple(tokens)].append((i, no))
    drop = defaultdict(set)
    for lines in leaves.values():
        todo = sorted(lines, key=lambda tk: (-len(lines[tk]), order(tk)))
        while todo:
            head = todo[0]
            same = [o for o in todo if o == head or sum(a == b for a, b in zip(o, head)) >= similar * len(head)]
            places = [p for o in same for p in lines[o]]
            if len({i for i, _ in places}) >= min_docs:
                first = min(i for i, _ in places)
                for i, no in places:
                    if i != first:
                        drop[i].add(no)
            todo = [o for o in todo if o not in same]
    return {i: "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in drop[i]) for i, t in texts.items()}
