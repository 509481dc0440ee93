"""Span search in its plainest form: every pattern over the whole text, every pair compared."""


def spans(text, detectors, allow=frozenset()):
    """(start, end, value, detector) by start."""
    found = []
    for order, d in enumerate(detectors):
        p = d.compiled()
        group = "pii" if "pii" in p.groupindex else 2 if d.split else 0
        for m in p.finditer(text or ""):
            if m[group] and (d.accept is None or d.accept(m, text)) and m[group].casefold() not in allow:
                found.append((-d.priority, -len(m[group]), m.start(group), order, m.end(group), m[group]))
    taken = []
    for c in sorted(found):
        if all(c[4] <= t[2] or t[4] <= c[2] for t in taken):
            taken.append(c)
    return [(c[2], c[4], c[5], detectors[c[3]]) for c in sorted(taken, key=lambda c: c[2])]
