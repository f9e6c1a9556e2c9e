"""Typed dates of a text: written dates in English, German, French and Spanish, each with the role that the nearest cue
gives it. Column expressions.

A cue stands before the date or shortly after it, with no end of a sentence, "and" or other date between; the nearer one
wins, of two equally near ones the one before the date. Without a cue a date is the publication's. Numbers alone are
read month first in English if they can be, else day first. Days that no calendar has are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.model import once

KINDS = ("publication", "effective", "enforcement", "last_modified", "expiry", "review", "consultation_start", "consultation_end")
#: Cues of each kind, English, German, French, Spanish.
CUES = {
    "publication": "publish|publication|gazett|issued|veröffentlich|bekanntmachung|bekanntgegeben|publi[ée]|journal officiel|publicad|publicación|bolet[ií]n oficial",
    "effective": "effective|in(?:to)? force|commenc|takes? effect|in kraft|wirksam|gilt ab|en vigueur|prend effet|applicable|en vigor|vigencia|surte efecto",
    "enforcement": "enforce|vollzug|durchsetzung|sanction|aplicación",
    "last_modified": "amend|last modified|revised|updated|geändert|änderung|modifié|modification|modificad",
    "expiry": "expir|sunset|repeal|ceases?|außer kraft|läuft ab|gültig bis|jusqu|abrog|caduca|vence|derog",
    "review": "review|überprüf|réexam|révision|revisión",
    "consultation_start": "consultation (?:opens|starts|begins)|konsultation beginnt|consultation ouvre|consulta (?:comienza|abre)",
    "consultation_end": "consultation (?:closes|ends)|comments? (?:due|by)|konsultation endet|consultation (?:close|se termine)|consulta (?:cierra|termina)",
}
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
#: Month by name and by its first three letters, where these tell it, or four.
MONTH = {n: i for names in MONTHS.values() for i, n in enumerate(names.split(), 1)}
MONTH |= {n[:k]: i for k in (3, 4) for names in MONTHS.values() for i, n in enumerate(names.split(), 1) if len({j for m in MONTHS.values() for j, x in enumerate(m.split(), 1) if x.startswith(n[:k])}) == 1}
NAME = "|".join(sorted(MONTH, key=lambda n: (-len(n), n)))
ISO, NUMBERS = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})[./](\d{1,2})[./](\d{4})"
DAY_FIRST = rf"(\d{{1,2}})(?:st|nd|rd|th|er|\.|º)?\s+(?:of\s+|de\s+)?({NAME})\.?,?\s+(?:del?\s+)?(\d{{4}})"
MONTH_FIRST = rf"({NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
FLAGS = "(?iu)"
ANY = rf"{FLAGS}(?<![\d\p{{L}}/.-])(?:{ISO}|{NUMBERS}|{DAY_FIRST}|{MONTH_FIRST})(?![\d\p{{L}}])"
#: How far cues are looked for, before and after; where they are near.
BEFORE, AFTER, NEAR = 90, 40, 25
AND = "and|und|et|y"
#: So many units after another date: number, unit, which date.
AFTER_OTHER = rf"{FLAGS}(\d{{1,4}})\s+(days?|tagen?|jours?|días?|weeks?|wochen?|semaines?|semanas?|months?|monaten?|mois|mes(?:es)?)\s+(?:after|following|nach|après|después de)\s+(?:\p{{L}}+\s+)?({'|'.join((CUES['publication'], CUES['effective']))})"
FOUND = "array<struct<kind:string,date:date,confidence:double,text:string>>"


def day(text: Column, month_first: Column) -> Column:
    """The day that a written date names; null if no calendar has it."""
    part = lambda p, i: F.regexp_extract(text, FLAGS + "^" + p + "$", i)
    number = lambda c: c.try_cast("int")
    months = F.create_map(*[F.lit(x) for kv in MONTH.items() for x in kv])
    month = lambda c: F.try_element_at(months, F.lower(c))

    def made(y: Column, m: Column, d: Column) -> Column:
        return once(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: F.when(x["m"].between(1, 12) & x["d"].between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]), "yyyy-MM-dd")))

    def numbers(x: Column) -> Column:
        a, b = x["a"], x["b"]
        swap = month_first & (a <= 12) | (b > 12)
        return made(x["y"], F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a))

    year = number(F.right(text, F.lit(4)))
    pieces = F.split(text, "[./]")
    return (
        F.when(text.rlike(f"^{ISO}$"), made(number(F.left(text, F.lit(4))), number(F.substring(text, 6, 2)), number(F.right(text, F.lit(2)))))
        .when(text.rlike(f"^{NUMBERS}$"), once(F.struct(number(F.get(pieces, 0)).alias("a"), number(F.get(pieces, 1)).alias("b"), year.alias("y")), numbers))
        .when(text.rlike(r"^\d"), made(year, month(part(DAY_FIRST, 2)), number(F.regexp_extract(text, r"^\d{1,2}", 0))))
        .otherwise(made(year, month(part(MONTH_FIRST, 1)), number(F.regexp_extract(text, r"(?iu)(\d{1,2})(?:st|nd|rd|th)?,?\s+\d{4}$", 1)))))


def folded(c: Column) -> Column:
    """In small letters, one for each letter, as (?iu) takes them; patterns without flags are several times as fast."""
    return F.lower(F.translate(c, "\u0130\u017f\u0131\u212a", "isik"))


def role(before: Column, after: Column) -> Column:
    """(distance, kind) of the nearest cue in folded texts; null without one."""
    every = "|".join(CUES.values())

    def cues(c: Column, side: int) -> Column:
        found = []
        for k, (kind, words) in enumerate(CUES.items()):
            rest = F.regexp_extract(c, f"(?s)^(.*?)(?:{words})" if side else f"(?s)^.*(?:{words})(.*)$", 1)
            found.append(F.when(c.rlike(words), F.struct(F.length(rest).alias("far"), F.lit(side).alias("side"), F.lit(k).alias("order"), F.lit(kind).alias("kind"))))
        return F.when(c.rlike(every), F.array_min(F.array(*found)))

    return once(F.struct(before.alias("b"), after.alias("a")), lambda x: F.array_min(F.array(cues(x["b"], 0), cues(x["a"], 1))))


def typed_dates(text: Column, lang: Column) -> Column:
    """Dates of a text in order: kind, date, confidence (.9 near a cue, .7 within reach, else .5) and the text of each."""

    def entries(z: Column) -> Column:
        def entry(m: Column, i: Column) -> Column:
            before = F.regexp_replace(F.right(F.get(z["p"], i), F.lit(BEFORE)), rf"(?isu)^.*(?:[.;!?]|\s(?:{AND}))\s", "")
            after = F.regexp_replace(F.left(F.get(z["p"], i + 1), F.lit(AFTER)), rf"(?isu)(?:[.;,!?](?:\s|$)|\s(?:{AND})\s).*$", "")
            at = F.coalesce(day(m, lang == "en"), F.lit(None).cast("date"))
            return once(role(folded(before), folded(after)), lambda r: F.struct(F.coalesce(r["kind"], F.lit("publication")).alias("kind"), at.alias("date"), F.when(r["far"] <= NEAR, 0.9).when(r.isNotNull(), 0.7).otherwise(0.5).alias("confidence"), m.alias("text")))

        return F.filter(F.transform(z["m"], entry), lambda e: e["date"].isNotNull())

    held = once(F.struct(F.split(text, ANY, -1).alias("p"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("m")), entries)
    found = F.when(text.rlike(r"\d{4}"), held).otherwise(F.array().cast(FOUND))
    return F.coalesce(once(found, lambda f: F.concat(f, relative_dates(text, f))), F.array().cast(FOUND))


def relative_dates(text: Column, found: Column) -> Column:
    """Dates that the text counts from its publication or effect, as effective dates; none if that date isn't there."""
    said = F.regexp_extract_all(text, F.lit(AFTER_OTHER), F.lit(0))

    def entry(s: Column) -> Column:
        g = lambda i: F.regexp_extract(s, AFTER_OTHER, i)
        since = F.when(g(3).rlike(f"(?iu)^(?:{CUES['publication']})"), "publication").otherwise("effective")
        base = F.get(F.filter(found, lambda f: f["kind"] == since), 0)["date"]
        n, unit = g(1).cast("int"), F.lower(g(2))
        at = F.when(unit.rlike("^(?:day|tag|jour|día)"), F.date_add(base, n)).when(unit.rlike("^(?:w|sem)"), F.date_add(base, n * 7)).otherwise(F.add_months(base, n))
        return F.struct(F.lit("effective").alias("kind"), at.alias("date"), F.lit(0.7).alias("confidence"), s.alias("text"))

    return F.filter(F.transform(said, entry), lambda e: e["date"].isNotNull())


def reply_dates(reply: Column, now: Column) -> Column:
    """Dates of a model's reply: without a kind the publication's, without a date now, without confidence .5. Null for a
    reply that can't be read, or with a kind that isn't known."""
    r = F.from_json(reply, "dates_found array<struct<date_type:string,date:string,confidence:double,original_text:string>>")
    made = F.transform(F.coalesce(r["dates_found"], F.array().cast("array<struct<date_type:string,date:string,confidence:double,original_text:string>>")), lambda x: F.struct(
        F.coalesce(x["date_type"], F.lit("publication")).alias("kind"), F.when(F.coalesce(x["date"], F.lit("")) == "", now.cast("date")).otherwise(F.left(x["date"], F.lit(10)).try_cast("date")).alias("date"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(x["original_text"], F.lit("")).alias("text")))
    good = F.forall(made, lambda m: m["kind"].isin(*KINDS) & m["date"].isNotNull())
    return F.when(F.try_parse_json(reply).isNotNull() & good, made)


def may_name(text: Column, on: Column) -> Column:
    """False only for texts that can't date anything to the day: they neither hold its year and its day of the month, as
    every written date does, nor count from another date."""
    written = text.contains(F.date_format(on, "yyyy")) & F.rlike(text, F.concat(F.lit("(?<![0-9])0?"), F.dayofmonth(on).cast("string"), F.lit("(?![0-9])")))
    return written | text.rlike(r"(?iu)\s(?:after|following|nach|après|después)\s")


def todays(records: DataFrame, dates: str, on: Column) -> DataFrame:
    """``records`` whose typed dates (column ``dates``) hold a publication or an effect on a day, with both flags."""
    has: Callable[[str], Column] = lambda kind: F.array_contains(F.transform(F.filter(dates, lambda d: d["kind"] == kind), lambda d: d["date"]), on)
    # made rows, as the optimizer would read the dates of all rows again for a condition on them
    flags = F.array(F.struct(has("publication").alias("published_today"), has("effective").alias("effective_today")))
    return records.drop("published_today", "effective_today").select("*", F.inline_outer(flags)).where("published_today OR effective_today")
