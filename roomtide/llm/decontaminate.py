"""Documents that contain benchmark questions, also with other numbers, names or units.

Texts become sequences of tokens in which numbers, names and units are typed placeholders that keep
their value aside. Windows of the sequences are hash-joined with those of the benchmark, and a match
counts only if the values in its slots are replaced consistently: along a stretch of one alignment
of question and document, every value stands for one other value and the other way round. A question
asked with new numbers passes this check; an unrelated sentence of the same shape does not. What
contradicts a stretch elsewhere in the alignment only ends it.

Everything is DataFrame functions. One pass over a text finds its tokens; only hashes, ids and
positions are joined with the benchmark, and tokens are looked up again for the few documents that
match. Alignments start from the windows of a question that few other questions have, so that an
instruction that all questions share does not pair every document that has it with all of them. What
matches in such shared windows alone is found with `rest`, which aligns a document once with what
many questions share, not with each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.sources.scratch import stored

WINDOW = 8
#: So many consecutive tokens must match; questions with fewer must match as a whole.
MIN_TOKENS = 13
#: A window with fewer plain words says too little.
MIN_PLAIN = 4
#: Alignments with a question start from windows that no more questions have, or as few as any window
#: of the question; without one, a stretch counts only with `rest`.
SHARED = 16

_NUMBER, _NAME, _UNIT = "\ue000", "\ue001", "\ue002"
#: Between the words of one name.
_JOIN = "\ue003"

_SIGNS = "$€£¥%°"
#: A number has all its groups of digits (7.5, 1,200). A name is a capitalised word of two letters or
#: more with the capitalised words that follow it, wherever it stands.
_TOKEN = (
    r"\p{Nd}++(?:[.,]\p{Nd}++)*+"
    r"|\p{Lu}[\p{L}\p{M}]++(?:[\s-]++\p{Lu}[\p{L}\p{M}]++)*+"
    rf"|[\p{{L}}\p{{M}}]++|[{_SIGNS}]"
)

ONES = "zero one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: These go on with the number in front of them: three hundred, 5 million.
SCALES = "hundred thousand million billion trillion dozen".split()
NUMBER_WORDS = frozenset(
    ONES
    + "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    + TENS
    + SCALES
)


def _unit_words() -> frozenset[str]:
    """Unit symbols and words in lower case: every prefix with every base, and those without prefix."""
    symbols = {
        prefix + base
        for prefix in ("", *"n u µ μ m c d h k g t p".split())
        for base in "m g l s w v b wh hz pa ev bit bits byte bytes".split()
    }
    long_bases = "meter metre gram liter litre watt volt byte bit second joule hertz pascal".split()
    words = {
        prefix + base + plural
        for prefix in ("", *"nano micro milli centi deci kilo mega giga tera peta".split())
        for base in long_bases
        for plural in ("", "s")
    }
    others = (
        "mile yard inch pound ounce gallon pint minute hour day week month year decade "
        "dollar euro cent franc rupee yen degree ton tonne acre hectare newton ampere kelvin"
    ).split()
    irregular = (
        "feet foot ft inches in percent lbs lb oz mph kmh kph min mins sec secs hr hrs am pm usd eur gbp"
    ).split()
    plurals = {word + "s" for word in others}
    return frozenset(symbols | words | set(others) | plurals | set(irregular)) - {"in", "am"}


UNITS = _unit_words()
_SPECIAL = NUMBER_WORDS | UNITS


def _among(value: str, words: Iterable[str]) -> str:
    return f"{value} IN ({', '.join(repr(w) for w in sorted(words))})"


def _starts_with_digit(token: str) -> str:
    return f"({token} >= '0' AND {token} < ':' OR {token} >= '\u0080' AND {token} RLIKE r'^\\p{{Nd}}')"


def _is_number(token: str) -> str:
    return f"({_starts_with_digit(token)} OR {_among(f'lower({token})', NUMBER_WORDS)})"


def _canonical(text: str, number: str, name: str, unit: str, word: str) -> Column:
    """Each token of a text column as the SQL for its kind makes it out of `token`. A number word that goes on with the number in front of it (twenty five, 3 million) is
    no token of its own. It is written as SQL text because of its long lists of words."""
    low, before = "lower(token)", "get(raw, at - 1)"
    goes_on = (
        f"({_among(low, SCALES)} AND {_is_number(before)}"
        f" OR {_among(low, ONES)} AND {_among(f'lower({before})', TENS)})"
    )
    beyond_ascii = "token >= '\u0080' AND lower(substring(token, 1, 1)) <> substring(token, 1, 1)"
    # Most tokens end at the first case; the order of the cases is that of their cost.
    kind = f"""CASE
      WHEN token >= 'a' AND token < '{{' AND NOT {_among(low, _SPECIAL)} THEN {word}
      WHEN {_starts_with_digit('token')} THEN {number}
      WHEN {_among(low, NUMBER_WORDS)} THEN CASE WHEN NOT coalesce({goes_on}, false) THEN {number} END
      WHEN {_among('token', _SIGNS)} THEN {unit}
      WHEN {_among(low, UNITS)} AND coalesce({_is_number(before)}, false) THEN {unit}
      WHEN (token >= 'A' AND token < '[' OR {beyond_ascii}) AND length(token) > 1 THEN {name}
      ELSE {word} END"""
    raw = f"regexp_extract_all(coalesce({text}, ''), r'{_TOKEN}', 0)"
    each = f"array_compact(transform(raw, (token, at) -> {kind}))"
    return F.expr(f"transform(array({raw}), raw -> {each})[0]")


def _tokens(text: str) -> Column:
    """Tokens of a text column, values of placeholders behind their marks; a null text has none."""
    return _canonical(
        text,
        number=f"concat('{_NUMBER}', lower(token))",
        name=rf"concat('{_NAME}', regexp_replace(lower(token), r'[\s-]+', '{_JOIN}'))",
        unit=f"concat('{_UNIT}', lower(token))",
        word="lower(token)",
    )


def _is_slot(token: Column) -> Column:
    return token.substr(1, 1).isin(_NUMBER, _NAME, _UNIT)


def _typed(token: Column) -> Column:
    return F.when(_is_slot(token), token.substr(1, 1)).otherwise(token)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once: a lambda computes what it captures for every element."""
    return F.transform(F.array(value), body)[0]


def _windows_of(hashes: Column, window: int) -> Column:
    """One hash for each position at which a window of tokens, given by their hashes, starts. Hashes of
    2, 4, ... tokens are made of two of half as many, the last of two that overlap."""

    def joined(parts: Column, width: int) -> Column:
        if width == window:
            return F.slice(parts, 1, F.size(hashes) - window + 1)
        step = min(width, window - width)
        behind = F.slice(parts, step + 1, F.size(hashes))
        pairs = F.zip_with(parts, behind, lambda a, b: F.xxhash64(a, b))
        return _once(pairs, lambda wider: joined(wider, width + step))

    return F.when(F.size(hashes) >= window, joined(hashes, 1))


def _token_windows(tokens: Column, window: int) -> Column:
    """The windows of `_tokens`."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(_typed(t)))
    return _once(hashes, lambda h: _windows_of(h, window))


def _text_windows(text: str, window: int) -> Column:
    """The same from a text column, without making the tokens' values."""
    hashes = _canonical(
        text,
        number=f"xxhash64('{_NUMBER}')",
        name=f"xxhash64('{_NAME}')",
        unit=f"xxhash64('{_UNIT}')",
        word="xxhash64(lower(token))",
    )
    return _once(hashes, lambda h: _windows_of(h, window))


def _conflict(left: Column, right: Column) -> Column:
    """Whether two lists of slots together give one value two meanings, or two values one."""
    return F.exists(
        left,
        lambda a: F.exists(
            right,
            lambda b: (a["item_part"] == b["item_part"]) != (a["doc_part"] == b["doc_part"]),
        ),
    )


def _inner_pair(pair: Column, at: Column) -> Column:
    """A token of the question and that of the text beside it, whether they `fit`, and whether it is a
    slot; if a name at either end of the question runs on into the text around it, its own words are
    its value."""
    item, doc = pair["item_part"], F.coalesce(pair["doc_part"], F.lit(""))
    value = item.substr(F.lit(2), F.length(item))
    runs_back = (at == 0) & doc.endswith(F.concat(F.lit(_JOIN), value))
    runs_on = (at == F.size("pairs") - 1) & doc.startswith(F.concat(item, F.lit(_JOIN)))
    own = F.when(_is_slot(item) & (runs_back | runs_on), item).otherwise(doc)
    return F.struct(
        item.alias("item_part"),
        own.alias("doc_part"),
        (_typed(item) == _typed(doc)).alias("fits"),
        _is_slot(item).alias("is_slot"),
    )


def _matches(pairs: Column, window: int) -> Column:
    """`item_at` and `slots` of the usable windows of which all tokens fit."""

    def part(at: Column) -> Column:
        return F.slice(pairs, at + 1, window)

    fitting = F.filter("usable", lambda at: F.forall(part(at), lambda p: p["fits"]))
    return F.transform(
        fitting,
        lambda at: F.struct(
            at.alias("item_at"),
            F.transform(
                F.filter(part(at), lambda p: p["is_slot"]),
                lambda p: F.struct(p["item_part"].alias("item_part"), p["doc_part"].alias("doc_part")),
            ).alias("slots"),
        ),
    )


def _same_values(slots: Column) -> Column:
    return F.forall(slots, lambda p: p["item_part"] == p["doc_part"])


def _longest_stretch(matches: Column) -> Column:
    """`n` and `exact` of the longest stretch of windows (sorted, each with its `slots`) in which
    slots are consistent; of two equally long ones, an exact one counts."""

    def longer(state: Column, match: Column) -> Column:
        slots = match["slots"]
        contradicts = F.transform(state["stretch"], lambda earlier: _conflict(earlier, slots))
        # array_position counts from 1, and the last contradiction is the first of the reverse.
        back = F.array_position(F.reverse(contradicts), True).cast("int")
        n_kept = F.when(back > 0, back - 1).otherwise(F.size(contradicts))
        kept = F.slice(state["stretch"], F.size(contradicts) - n_kept + 1, n_kept)
        empty = F.slice(state["stretch"], 1, 0)
        stretch = F.when(_conflict(slots, slots), empty).otherwise(
            F.concat(kept, F.array(slots))
        )
        return _once(
            stretch,
            lambda new: F.struct(
                new.alias("stretch"),
                F.greatest(
                    state["best"],
                    F.struct(F.size(new).alias("n"), F.forall(new, _same_values).alias("exact")),
                ).alias("best"),
            ),
        )

    none = F.struct(
        F.slice(F.transform(matches, lambda m: m["slots"]), 1, 0).alias("stretch"),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("exact")).alias("best"),
    )
    return F.aggregate(matches, none, longer, lambda state: state["best"])


def _forms(benchmark: DataFrame) -> DataFrame:
    """`item_id` and `tokens` of every question as it stands, with a small first letter, all in small
    letters, and as it reads after a number (its first word may be a unit then)."""
    text = F.regexp_replace("text", r"^[^\p{L}\p{M}\p{Nd}]+", "")
    small = F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    after_number = F.concat(F.lit("0 "), text)
    readings = F.posexplode(F.array(text, small, F.lower(text), after_number)).alias("form", "text")
    read = benchmark.where("text IS NOT NULL").select("item_id", readings)
    tokens = read.select("item_id", "form", _tokens("text").alias("tokens"))
    own = F.when(F.col("form") == 3, F.slice("tokens", 2, 1 << 30)).otherwise(F.col("tokens"))
    return tokens.select("item_id", own.alias("tokens"))


def _items(benchmark: DataFrame, window: int, min_plain: int) -> DataFrame:
    """`item_id`, `item_text` (which tells forms apart), `tokens`, and `usable`, the places of the
    windows that say enough, from 0. A word counts as plain in every form if it does in one."""
    items = _forms(benchmark).select("item_id", F.xxhash64("tokens").alias("item_text"), "tokens")
    items = items.dropDuplicates(["item_id", "item_text"]).where(F.size("tokens") >= window)
    starts = F.sequence(F.lit(0), F.size("tokens") - window)

    def says_enough(at: Column) -> Column:
        part = F.slice("tokens", at + 1, window)
        # The first word is plain in one form, and a window says as much in every form.
        first_word = (at == 0) & part[0].substr(1, 1).isin(_NAME, _UNIT)
        return F.size(F.filter(part, lambda t: ~_is_slot(t))) + first_word.cast("int") >= min_plain

    return items.withColumn("usable", F.filter(starts, says_enough)).where(F.size("usable") > 0)


def _usable_windows(items: DataFrame, window: int, *ids: str) -> DataFrame:
    """`item_at` and `hash` of the usable windows, beside `ids`."""
    hashes = F.posexplode(_token_windows(F.col("tokens"), window)).alias("item_at", "hash")
    usable = items.select(*ids, "usable", hashes).where(F.array_contains("usable", F.col("item_at")))
    return usable.drop("usable")


def _anchors(items: DataFrame, window: int, shared: int) -> DataFrame:
    """The windows that alignments start from: `item_id`, `item_text`, `item_at`, `hash`."""
    hashes = _usable_windows(items, window, "item_id", "item_text")
    # Bounded by the benchmark: one row for each window of each question.
    n_items = hashes.groupBy("hash").agg(F.count_distinct("item_id").alias("n_items"))
    counted = hashes.join(n_items, "hash")
    fewest = F.min("n_items").over(Window.partitionBy("item_id", "item_text"))
    chosen = counted.withColumn("fewest", fewest).where(
        F.col("n_items") <= F.greatest(F.lit(shared), F.col("fewest"))
    )
    return chosen.select("item_id", "item_text", "item_at", "hash")


def _shared_parts(items: DataFrame, anchors: DataFrame, window: int, needed: int) -> DataFrame:
    """What every form is without its anchors: `item_id`, `item_text`, `part` (the same for forms with
    the same rest), `begin` (its place in the form), `tokens` and `usable`. Tokens in none of the
    windows that are left are empty; one such token stays at an end where the question goes on, as
    `_inner_pair` asks for the question's own ends. Fewer than `needed` windows never are enough."""
    own = anchors.groupBy("item_id", "item_text").agg(F.collect_set("item_at").alias("own"))
    rest = F.array_except("usable", "own")
    left = items.join(own, ["item_id", "item_text"]).withColumn("rest", rest)
    inside = F.array_distinct(
        F.flatten(F.transform("rest", lambda at: F.sequence(at, at + (window - 1))))
    )
    last = F.element_at("rest", -1) + window
    left = left.where(F.size("rest") >= F.greatest(F.lit(needed), F.lit(1))).select(
        "*",
        inside.alias("inside"),
        F.greatest(F.element_at("rest", 1) - 1, F.lit(0)).alias("begin"),
        F.least(last + 1, F.size("tokens")).alias("end"),
    )
    masked = F.transform(
        "tokens",
        lambda token, at: F.when(F.array_contains("inside", at), token).otherwise(""),
    )
    parts = left.select(
        "item_id",
        "item_text",
        "begin",
        F.slice(masked, F.col("begin") + 1, F.col("end") - F.col("begin")).alias("tokens"),
        F.transform("rest", lambda at: at - F.col("begin")).alias("usable"),
    )
    return parts.withColumn("part", F.xxhash64("tokens", "usable"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_tokens: int = MIN_TOKENS,
    min_plain: int = MIN_PLAIN,
    shared: int = SHARED,
    rest: bool = False,
) -> DataFrame:
    """`doc_id`, `item_id`, `n_windows`, `exact` for every document and question found in it.

    A question is found if, in a stretch of one alignment with consistent slots, at least as many
    windows match as `min_tokens` consecutive tokens have, or all that a question with fewer has.
    Without `rest`, one of the alignment's windows must be in at most `shared` questions (or in as few
    as any window of the question); with it, stretches that more questions share are found for all
    of them. `n_windows` is the largest number over stretches, `exact` says that no slot of it
    differs. Windows are whole texts' windows. Questions of fewer than `window` tokens and windows
    with fewer than `min_plain` plain words identify nothing, and a copy in capitals only is not
    recognised. Null texts have no windows, null ids are ids of their own, repeated rows count once;
    other columns are ignored; empty tables give no rows."""
    found, members, starts = _stretches(docs, benchmark, window, min_tokens, min_plain, shared, rest)
    if rest:
        found = _for_every_item(found, members, starts)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("best.n").cast("long").alias("n_windows"),
        F.max_by(F.col("best.exact"), F.col("best")).alias("exact"),
    )


def stretches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_tokens: int = MIN_TOKENS,
    min_plain: int = MIN_PLAIN,
    shared: int = SHARED,
) -> DataFrame:
    """What `contaminated` finds without `rest`, by text: `doc_id`, `doc_text` (the hash of
    `identified`), `item_id` and the `best` stretch of each alignment."""
    found, _, _ = _stretches(docs, benchmark, window, min_tokens, min_plain, shared, False)
    return found.select("doc_id", "doc_text", "item_id", "best")


def contaminated_texts(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_tokens: int = MIN_TOKENS,
    min_plain: int = MIN_PLAIN,
    shared: int = SHARED,
) -> DataFrame:
    """`doc_id` and `doc_text` (the hash of `identified`) of every text in which `contaminated` finds a
    question with `rest`. A part counts unless all questions that have it are aligned at its place
    with all of their windows, so that no text is paired with each of them."""
    found, members, starts = _stretches(docs, benchmark, window, min_tokens, min_plain, shared, True)
    n_having = members.groupBy("part").agg(F.count("*").alias("n_having"))
    aligned = starts.join(members, ["item_id", "item_text"]).select(
        "d", "t", F.col("part").alias("of"), (F.col("shift") + F.col("begin")).alias("place")
    )
    n_aligned = aligned.groupBy("d", "t", "of", "place").agg(F.count("*").alias("n_aligned"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("d"))
        & (F.col("doc_text") == F.col("t"))
        & (F.col("part") == F.col("of"))
        & (F.col("shift") == F.col("place"))
    )
    counted = found.join(n_having, "part", "left").join(n_aligned, same, "left")
    others = F.col("n_having") > F.coalesce("n_aligned", F.lit(0))
    return counted.where(F.col("part").isNull() | others).select("doc_id", "doc_text").distinct()


def _for_every_item(found: DataFrame, members: DataFrame, starts: DataFrame) -> DataFrame:
    """`doc_id`, `item_id` and `best` of `_stretches`: a part's rows are given to the questions that
    have it, but not where an alignment with all of the question's windows starts."""
    having = members.select("part", F.col("item_id").alias("having"), "item_text", "begin")
    every = found.join(having, "part", "left").select(
        "doc_id",
        "doc_text",
        F.coalesce("item_id", "having").alias("item_id"),
        "having",
        F.col("item_text").alias("having_text"),
        (F.col("shift") - F.col("begin")).alias("place"),
        "best",
    )
    whole = starts.withColumnRenamed("item_id", "item")
    same = (
        F.col("doc_id").eqNullSafe(F.col("d"))
        & (F.col("doc_text") == F.col("t"))
        & (F.col("having") == F.col("item"))
        & (F.col("having_text") == F.col("item_text"))
        & (F.col("place") == F.col("shift"))
    )
    return every.join(whole, same, "left_anti").select("doc_id", "item_id", "best")


def _stretches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int,
    min_tokens: int,
    min_plain: int,
    shared: int,
    rest: bool,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """`doc_id`, `doc_text`, `item_id`, `shift` and the `best` stretch of each alignment that starts
    from an anchor, with null as `part`. With `rest` also alignments with what many questions share:
    they have a `part` and no `item_id`. Next to them the forms that have each part (`part`,
    `item_id`, `item_text`, `begin`) and the alignments that start from anchors (`d`, `t`,
    `item_id`, `item_text`, `shift`)."""
    items = stored(_items(benchmark, window, min_plain), "items")
    anchors = stored(_anchors(items, window, shared), "anchors")
    hashes, least = anchors.select("hash"), min_tokens - window + 1
    members = None
    if rest:
        members = stored(_shared_parts(items, anchors, window, least), "members")
        parts = stored(members.select("part", "tokens", "usable").dropDuplicates(["part"]), "parts")
        part_windows = stored(_usable_windows(parts, window, "part"), "part-windows")
        hashes = hashes.union(part_windows.select("hash"))
    narrow = docs.where("text IS NOT NULL").select(
        "doc_id", "text", F.xxhash64("text").alias("doc_text")
    )
    windows = narrow.select(
        "doc_id",
        "doc_text",
        F.posexplode(_text_windows("text", window)).alias("doc_at", "hash"),
    )
    hashes = stored(hashes.distinct(), "anchor-hashes")
    hits = stored(windows.join(hashes, "hash", "left_semi").distinct(), "window-hits")
    shift = (F.col("doc_at") - F.col("item_at")).alias("shift")
    place = [F.col("doc_id").alias("d"), F.col("doc_text").alias("t"), shift]
    starts = hits.join(anchors, "hash").select("item_id", "item_text", *place).distinct()
    starts = stored(starts, "starts")
    aligned_with = starts.join(items, ["item_id", "item_text"])
    matched = starts.select("d", "t")
    if rest:
        # A row for each window that matches, so that the rest of a place is known to be too little.
        counted = hits.join(part_windows, "hash").select("part", *place)
        counted = counted.groupBy("part", "d", "t", "shift").agg(F.count("*").alias("n"))
        part_starts = stored(counted.where(F.col("n") >= least).drop("n"), "part-starts")
        aligned_with = aligned_with.unionByName(
            part_starts.join(parts, "part"), allowMissingColumns=True
        )
        matched = matched.union(part_starts.select("d", "t"))
    else:
        aligned_with = aligned_with.withColumn("part", F.lit(None).cast("long"))
    matched = stored(matched.distinct(), "matched")
    same_doc = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_text") == F.col("t"))
    tokens = (
        narrow.join(matched, same_doc, "left_semi")
        .dropDuplicates(["doc_id", "doc_text"])
        .select("doc_id", "doc_text", _tokens("text").alias("doc_tokens"))
    )
    # The question's tokens beside those of the text; before and behind the text there are none.
    beside = F.transform(
        "tokens",
        lambda token, at: F.struct(
            token.alias("item_part"),
            F.get("doc_tokens", F.col("shift") + at).alias("doc_part"),
        ),
    )
    ids = ["doc_id", "doc_text", "item_id", "part", "shift"]
    aligned = tokens.join(aligned_with, same_doc).select(*ids, "usable", beside.alias("pairs"))
    matches = aligned.select(
        *ids,
        F.size("usable").alias("item_windows"),
        _once(F.transform("pairs", _inner_pair), lambda pairs: _matches(pairs, window)).alias("matches"),
    )
    needed = F.least(F.lit(least), F.col("item_windows"))
    along = matches.where(F.size("matches") >= needed)
    slots = F.array_distinct(F.flatten("matches.slots"))
    whole = F.struct(F.size("matches").alias("n"), _same_values(slots).alias("exact"))
    best = F.when(_conflict(slots, slots), _longest_stretch(F.col("matches"))).otherwise(whole)
    found = along.withColumn("best", best).where(F.col("best.n") >= needed)
    return found.select(*ids, "best"), members, starts
