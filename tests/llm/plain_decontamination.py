"""One plain version of the rules of decontamination, on lists, for all tests."""

from __future__ import annotations

import regex

from roomtide.llm import decontaminate as D

KINDS = {D._NUMBER: "number", D._NAME: "name", D._UNIT: "unit"}
_NAME_RUN = regex.compile(r"\p{Lu}[\p{L}\p{M}]+")
_PIECE = regex.compile(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}]+|[$€£¥%°]")


def plain_tokens(text: str) -> list[tuple[str, str]]:
    """Kind and value of every token, one by one."""
    pieces = []
    for found in _PIECE.finditer(text):
        piece, capital = found[0], bool(_NAME_RUN.fullmatch(found[0]))
        between = text[pieces[-1][2] : found.start()] if pieces else ""
        if capital and pieces and pieces[-1][1] and regex.fullmatch(r"[ \t\n\x0b\x0c\r-]+", between):
            pieces[-1] = (f"{pieces[-1][0]} {piece}", True, found.end())
        else:
            pieces.append((piece, capital, found.end()))
    tokens, before = [], ""
    for piece, capital, _ in pieces:
        low, last = piece.lower(), before
        before = low
        after_number = bool(regex.match(r"\p{Nd}", last)) or last in D.NUMBER_WORDS
        if regex.match(r"\p{Nd}", piece):
            tokens.append(("number", piece))
        elif low in D.NUMBER_WORDS:
            goes_on = (low in D.SCALES and after_number) or (low in D.ONES and last in D.TENS)
            if not goes_on:
                tokens.append(("number", low))
        elif (low in D.UNITS and after_number) or piece in "$€£¥%°":
            tokens.append(("unit", low))
        elif capital:
            tokens.append(("name", low))
        else:
            tokens.append(("word", low))
    return tokens


def forms(question: str) -> list[list[tuple[str, str]]]:
    question = regex.sub(r"^[^\p{L}\p{M}\p{Nd}]+", "", question)
    readings = [
        plain_tokens(question),
        plain_tokens(f"0 {question}")[1:],
        plain_tokens(question[:1].lower() + question[1:]),
        plain_tokens(question.lower()),
    ]
    return [r for i, r in enumerate(readings) if r not in readings[:i]]


def shape(token):
    return token[1] if token[0] == "word" else (token[0],)


def own_words(item, doc, at):
    """The value in the text; a name that runs on at an end of the question counts its own words."""
    kind, value = item[at]
    if kind != "word":
        runs_back = at == 0 and doc[1].endswith(f" {value}")
        runs_on = at == len(item) - 1 and doc[1].startswith(f"{value} ")
        if runs_back or runs_on:
            return item[at]
    return doc


def best_stretch(slots_at, places):
    """The longest run of matching windows in which values are replaced one to one."""
    best = (0, True)
    for i in range(len(places)):
        for j in range(i, len(places)):
            slots = set().union(*(slots_at[p] for p in places[i : j + 1]))
            if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
                best = max(best, (j + 1 - i, all(a == b for a, b in slots)))
    return best


def plain_contaminated(rows, questions, window=8, min_tokens=13, min_plain=4, shared=16):
    """(doc_id, item_id, n_windows, exact) of everything found, by comparing every alignment."""
    items = []
    for item_id, question in questions:
        for item in forms(question or ""):
            usable = []
            for at in range(len(item) - window + 1):
                part = item[at : at + window]
                plain = sum(kind == "word" for kind, _ in part)
                plain += at == 0 and part[0][0] in ("name", "unit")
                if plain >= min_plain:
                    usable.append(at)
            if usable:
                items.append((item_id, item, usable))
    having: dict[tuple, set] = {}
    for item_id, item, usable in items:
        for at in usable:
            having.setdefault(tuple(map(shape, item[at : at + window])), set()).add(item_id)
    results = {}
    texts = {(doc_id, text) for doc_id, text in rows if text is not None}
    for doc_id, text in texts:
        doc = plain_tokens(text)
        at_of = {}
        for at in range(len(doc) - window + 1):
            at_of.setdefault(tuple(map(shape, doc[at : at + window])), []).append(at)
        for item_id, item, usable in items:
            shapes = {at: tuple(map(shape, item[at : at + window])) for at in usable}
            most = max(shared, min(len(having[s]) for s in shapes.values()))
            shifts = {
                d - at for at, s in shapes.items() if len(having[s]) <= most for d in at_of.get(s, ())
            }
            for shift in shifts:
                places = [at for at, s in shapes.items() if at + shift in at_of.get(s, ())]
                slots_at = {
                    at: {
                        (item[p], own_words(item, doc[p + shift], p))
                        for p in range(at, at + window)
                        if item[p][0] != "word"
                    }
                    for at in places
                }
                best = best_stretch(slots_at, places)
                if best[0] >= min(min_tokens - window + 1, len(usable)):
                    results[doc_id, item_id] = max(results.get((doc_id, item_id), best), best)
    return [(*key, *value) for key, value in results.items()]
