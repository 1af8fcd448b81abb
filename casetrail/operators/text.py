"""Notes: selection, reassembly, pattern flags, last numbers, vector pooling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions import fixed
from casetrail.functions.clock import boundaries
from casetrail.functions.scalars import try_code_in
from casetrail.operators.ordering import null_safe_join, ordered
from casetrail.operators.ranks import grouped_quantiles, value_band
from casetrail.operators.relational import assemble_text
from casetrail.operators.temporal import interval_join
from casetrail.session import spread


def note_timing(start: Column, created: Column, discharge: Column) -> tuple[Column, Column]:
    """(minutes after the start, hours before discharge), both in minute boundaries."""
    return boundaries("minute", start, created), boundaries("minute", created, discharge) / F.lit(60.0)


def notes(scope: DataFrame, headers: DataFrame, lines: DataFrame, types: Sequence[int] = fixed.NOTE_TYPE_CODES) -> DataFrame:
    """One row per signed note of a listed type written during the stay, with the text of its latest version.

    ``scope``: LogID, EncounterCSN, SurgeryStart, AdmitTime, DischargeTime. ``headers``: NOTE_ID, EncounterCSN,
    NoteTypeCode (text), NoteCreated, UNSIGNED_YN. ``lines``: NOTE_ID, NOTE_CSN_ID, Line, NOTE_TEXT.
    """
    signed = headers.where(try_code_in(F.col("NoteTypeCode"), types)
                           & (F.col("UNSIGNED_YN").isNull() | (F.col("UNSIGNED_YN") == "N"))).drop("UNSIGNED_YN")
    inside = interval_join(scope, signed, ["EncounterCSN"], "AdmitTime", "DischargeTime", "NoteCreated", 7 * 86400)
    picked = inside.drop("AdmitTime").distinct()
    wanted = lines.join(picked.select("NOTE_ID").distinct(), "NOTE_ID", "left_semi")
    latest = wanted.groupBy("NOTE_ID").agg(F.max("NOTE_CSN_ID").alias("NOTE_CSN_ID"))
    text = assemble_text(wanted.join(latest, ["NOTE_ID", "NOTE_CSN_ID"], "left_semi"), ["NOTE_ID"], "Line", "NOTE_TEXT")
    after, before = note_timing(F.col("SurgeryStart"), F.col("NoteCreated"), F.col("DischargeTime"))
    return picked.join(text, "NOTE_ID", "left").withColumns(
        {"MinutesAfterSurgeryStart": after, "HoursBeforeDischarge": before})


def lower_pattern(pattern: str) -> str:
    """Pattern with its letters in lower case; escapes such as ``\\D`` keep theirs."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0].startswith("\\") else m[0].lower(), pattern)


def joined_texts(texts: DataFrame, key: str, text: str, order: Sequence[str]) -> DataFrame:
    """All texts of a key as one, in order and with a blank between; null texts are left out.

    The result is one value per key, so its length is what one task must hold.
    """
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("__text")))))
    return texts.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["__text"]), " ").alias(text))


#: Characters of a joined text that are matched in one go; a window grows with the longest possible match.
WINDOW = 1 << 17

# What a pattern may consist of for the length of its matches to be known: flags, plain groups, one-character atoms.
_PATTERN_PART = re.compile(
    r"(?P<flags>\(\?[ims]+\))|(?P<open>\((?:\?:)?(?!\?))|(?P<close>\))|(?P<either>\|)|(?P<edge>\\[bB])"
    r"|(?P<atom>\\[wWdDsStnr]|\\[^\w]|\[\^?(?:\\[wWdDsStnr]|\\[^\w]|[^\]\[\\&])+\]|[^\\()\[\]|*+?{}^$])")
_TIMES = re.compile(r"(?P<sign>[*+?])\??(?!\+)|\{(?P<low>\d+)(?P<comma>,(?P<high>\d*))?\}\??(?!\+)")


def longest_match(pattern: str) -> tuple[int, list[str]] | None:
    """Upper bound of a match's length: characters, and atoms that repeat without limit, each by its longest run.

    None where the bound is not of this kind (anchors, look-around, back references, repeated groups, ``.*``) and for
    patterns that match the empty text.
    """
    at, size, runs = 0, 0, []
    while at < len(pattern):
        part = _PATTERN_PART.match(pattern, at)
        if part is None:
            return None
        at = part.end()
        times = _TIMES.match(pattern, at)
        at = times.end() if times else at
        if part["atom"]:
            if times and (times["sign"] in ("*", "+") or times["comma"] and not times["high"]):
                if part["atom"] == ".":
                    return None
                runs.append(part["atom"])
            else:
                size += int(times["high"] or times["low"]) if times and times["low"] else 1
        elif times and not (part["close"] and times["sign"] == "?"):
            return None
    try:
        return None if re.match(pattern, "") else (size, runs)
    except re.error:
        return None


def _overlap(texts: DataFrame, text: str, bounds: Sequence[tuple[int, list[str]]]) -> int:
    """Longest match that the patterns can have in these texts; runs of a repeated atom are measured."""
    atoms = sorted({atom for _, runs in bounds for atom in runs})
    if not atoms:
        return max(size for size, _ in bounds)
    measures = []
    for k, atom in enumerate(atoms):
        run = F.array_max(F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?i){atom}+"), F.lit(0)), lambda x: F.length(x)))
        longest = F.coalesce(F.max(run), F.lit(0))
        if re.match(atom, " "):
            # Such a run may go on over the blank between texts, through texts that consist of it.
            through = F.sum(F.when(F.col(text).rlike(f"(?i)\\A(?:{atom})*\\z"), F.length(text) + 1))
            longest = 2 * longest + 1 + F.coalesce(through, F.lit(0))
        measures.append(longest.cast("long").alias(f"m{k}"))
    found = texts.agg(*measures).first()
    length = dict(zip(atoms, found, strict=True))
    return max(size + sum(length[a] for a in runs) for size, runs in bounds)


def text_windows(texts: DataFrame, key: str, text: str, order: Sequence[str], overlap: int, window: int) -> DataFrame:
    """Pieces of each key's joined text: (key, text, ``__from``, ``__own``).

    A piece owns ``window`` characters of the joined text and shows one character before and ``overlap`` + 1 after them
    (a line feed at either end of the whole). ``__from`` is the place of its first character in the joined text,
    ``__own`` the place where the next piece begins. No value is longer than a piece or one text of the input.
    """
    rows = texts.where(F.col(text).isNotNull()).select(key, *[c for c in order if c != key], text)
    rows = rows.withColumn("__size", F.length(text).cast("long") + 1)
    kind = rows.schema[order[0]].dataType.typeName()
    spreadable = kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "date")
    first = F.unix_date(order[0]) if kind == "date" else F.col(order[0])
    chunk = F.coalesce(value_band(first), F.lit(-(2 ** 62))) if spreadable else F.lit(0).cast("long")
    placed = ordered(rows, [key], [*order, text], chunk, running={"__end": "__size"}, row_number="__nr", key_rows="__rows")
    begin = F.col("__end") - F.col("__size")
    last = F.col("__nr") == F.col("__rows")
    # The blank between two texts stands before the second; a line feed stands before the first and after the last.
    placed = placed.select(key, (begin - 1).alias("__begin"), F.concat(
        F.when(begin == 0, "\n").otherwise(" "), text, F.when(last, "\n").otherwise("")).alias("__part"))
    size = F.length("__part")
    low = F.greatest(F.lit(0), F.floor((F.col("__begin") - overlap - window) / F.lit(window)))
    high = F.floor((F.col("__begin") + size) / F.lit(window))
    dealt = placed.withColumn("__w", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))))
    start = F.greatest(F.col("__begin"), F.col("__w") * window - 1)
    stop = F.least(F.col("__begin") + size, (F.col("__w") + 1) * window + overlap + 1)
    cut = dealt.where(stop > start).select(key, "__w", F.struct(start.alias("at"), F.col("__part").substr(
        (start - F.col("__begin") + 1).cast("int"), (stop - start).cast("int")).alias("part")).alias("__piece"))
    whole = F.array_sort(F.collect_list("__piece"))
    return cut.groupBy(key, "__w").agg(F.array_join(F.transform(whole, lambda x: x["part"]), "").alias(text)).select(
        key, text, (F.col("__w") * window - 1).alias("__from"), ((F.col("__w") + 1) * window).alias("__own"))


def regex_flags(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str] | None = None,
                totals: Mapping[str, str] | None = None, order: Sequence[str] = (), window: int = WINDOW) -> DataFrame:
    """0/1 per pattern over the text of a key, prefix totals and ``has_notes``.

    With ``order`` the texts of a key are joined by a blank in that order and matched as one, so a match may span any
    number of them. Without it each key has one text (several are matched one by one, and none across them). Joined
    texts are matched in overlapping windows; only patterns whose matches have no bound (:func:`longest_match`) need
    the joined text as one value.
    """
    patterns = patterns or fixed.TEXT_PATTERNS
    totals = {"sdoh_total": "sdoh_", "med_total": "med_"} if totals is None else totals
    # Matching lower-case patterns on a lower-case text is faster than matching without regard to case.
    lowered = texts.withColumn(text, F.lower(text))

    def flags_of(rows: DataFrame, some: Mapping[str, str]) -> DataFrame:
        return rows.groupBy(key).agg(*[
            F.max(F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("int")).alias(n) for n, p in some.items()])

    small = {n: lower_pattern(p) for n, p in patterns.items()}
    bounds = {n: longest_match(p) for n, p in small.items()} if order else {}
    cut = {n: f"(?!\\A)(?:{small[n]})(?!\\z)" for n, bound in bounds.items() if bound}
    rest = {n: p for n, p in small.items() if n not in cut}
    parts = []
    if cut:
        overlap = _overlap(lowered, text, [bounds[n] for n in cut])
        pieces = text_windows(lowered, key, text, order, overlap, max(window, overlap)).select(key, text)
        parts.append(flags_of(pieces.unionByName(lowered.select(key, F.lit(None).cast("string").alias(text))), cut))
    if rest:
        parts.append(flags_of(spread(joined_texts(lowered, key, text, order) if order else lowered.select(key, text)), rest))
    flags = parts[0] if len(parts) == 1 else null_safe_join(parts[0], parts[1], [key], "inner")
    sums = {t: sum((F.col(n) for n in patterns if n.startswith(prefix)), F.lit(0)) for t, prefix in totals.items()}
    return flags.select(key, *patterns).withColumns(sums | {"has_notes": F.lit(1)})


def align_flags(cases: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Flags for every case; cases without text get zeros."""
    return cases.select(key).join(flags, key, "left").na.fill(0)


def last_numeric(texts: DataFrame, key: str, text: str, order: Sequence[str], patterns: Mapping[str, str] | None = None,
                 window: int = WINDOW) -> DataFrame:
    """Last number that follows each keyword in a key's texts, joined in order by a blank; null where there is none.

    Keyword and number may stand in different texts. Matches do not overlap: each is sought from the end of the one
    before. Windows of the joined text give the match at every place where one can begin; the last place that no match
    spans is where the search surely starts anew, and from there on the matches are taken in turn. Only patterns whose
    matches have no bound (:func:`longest_match`) need the joined text as one value.
    """
    patterns = patterns or fixed.TEXT_NUMBERS
    bounds = {n: longest_match(p) for n, p in patterns.items()}
    cut = {n: p for n, p in patterns.items() if bounds[n]}
    rest = {n: p for n, p in patterns.items() if n not in cut}
    parts = []
    if cut:
        overlap = _overlap(texts, text, [bounds[n] for n in cut])
        pieces = text_windows(texts, key, text, order, overlap, max(window, overlap))
        parts.append(_last_in_turn(texts, _possible_matches(pieces, key, text, cut), key, list(cut)))
    if rest:
        rows = spread(joined_texts(texts, key, text, order))
        parts.append(rows.select(key, *[F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(f"(?i){p}"), F.lit(1)), F.lit(-1)).cast("double").alias(n)
                                        for n, p in rest.items()]))
    found = parts[0] if len(parts) == 1 else null_safe_join(parts[0], parts[1], [key], "inner")
    return found.select(key, *patterns)


def _possible_matches(pieces: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, name, start, stop, value) of the match at every place of the joined texts where a pattern has one."""
    def matches(p: str) -> Column:
        ahead = f"(?i)(?=({p})(?!\\z))"
        parts = F.split(F.col(text), ahead, -1)
        found, values = (F.regexp_extract_all(F.col(text), F.lit(ahead), F.lit(g)) for g in (1, 2))
        # The text is split where a match begins, so part k + 1 begins with match k (part k, if one begins at once).
        shift = F.size(parts) - F.size(found)
        return F.transform(parts, lambda x, k: F.struct(
            F.length(x).alias("size"), F.length(F.get(found, k - shift)).alias("length"), F.get(values, k - shift).alias("value")))

    named = F.array(*[F.struct(F.lit(n).alias("name"), matches(p).alias("found")) for n, p in patterns.items()])
    rows = (pieces.select(key, "__from", "__own", F.inline(named))
            .select(key, "__from", "__own", "name", F.posexplode("found").alias("__k", "__m")))
    before = Window.partitionBy(key, "name", "__from").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__from") + F.coalesce(F.sum("__m.size").over(before), F.lit(0))
    rows = rows.select(key, "name", "__from", "__own", start.alias("start"), F.col("__m.length").alias("length"), F.col("__m.value").alias("value"))
    return rows.where(F.col("length").isNotNull() & (F.col("start") > F.col("__from")) & (F.col("start") < F.col("__own"))).select(
        key, "name", "__from", "start", (F.col("start") + F.col("length")).alias("stop"), "value")


def _last_in_turn(texts: DataFrame, found: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Value of the last match when each is sought from the end of the one before."""
    keys = [key, "name"]
    here = Window.partitionBy(*keys, "__from").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    reached = found.groupBy(*keys, "__from").agg(F.max("stop").alias("__m")).select(
        *keys, "__from", F.max("__m").over(earlier).alias("__reach"))
    inside = found.withColumn("__here", F.max("stop").over(here))
    rows = null_safe_join(inside, reached, [*keys, "__from"], "inner")
    free = F.coalesce(F.greatest("__here", "__reach") <= F.col("start"), F.lit(True))
    fresh = rows.groupBy(*keys).agg(F.max(F.when(free, F.col("start"))).alias("__fresh"))
    tail = null_safe_join(rows, fresh, keys, "inner").where(F.col("start") >= F.col("__fresh"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "stop", "value")))
    none = F.struct(F.lit(-1).cast("long").alias("stop"), F.lit(None).cast("string").alias("value"))
    taken = F.aggregate(in_order, none, lambda state, m: F.when(m["start"] >= state["stop"], F.struct(
        m["stop"].alias("stop"), m["value"].alias("value"))).otherwise(state))
    last = tail.groupBy(*keys).agg(taken["value"].cast("double").alias("__v"))
    every = texts.select(key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("__v"))
    return last.unionByName(every).groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in names])


def fill_with_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by the column's median; one pass finds the medians of all columns."""
    columns = list(columns)
    if not columns:
        return df
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], columns, "__column", "__value")
    middles = grouped_quantiles(long, ["__column"], "__value", {"m": 0.5}).agg(
        F.map_from_entries(F.collect_list(F.struct("__column", "m"))).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at(middles, F.lit(c))) for c in columns})


def pool_notes(vectors: DataFrame, cases: DataFrame, key: str, columns: Sequence[str], kind: str | None = None,
               kinds: Sequence[str] = fixed.NOTE_TYPE_ORDER) -> DataFrame:
    """Mean vector per case, or one block of means per note type side by side; absent blocks are 0."""
    if kind is None:
        pooled = vectors.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    else:
        pooled = vectors.groupBy(key).agg(*[
            F.avg(F.when(F.col(kind) == t, F.col(c))).alias(f"{t}_{c}") for t in kinds for c in columns])
    return cases.select(key).join(pooled, key, "left").na.fill(0.0)
