"""Word lists. The name list is a table (key, first, last, ambiguous); the seeds here serve tests and small jobs, a real
job passes its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.functions.text import fold, umlaut_variant

#: Seeds: given names, surnames, and names that are ordinary words too, all folded.
GIVEN = "anna lena maria julia laura sophie emma clara peter paul max jonas lukas thomas stefan ahmet ayse mehmet fatma chidi ngozi ivan olga john mary susan david marta jan piotr"
SURNAMES = "muller schmidt schneider fischer weber meier wagner becker hoffmann schulz krause lehmann yilmaz kaya demir okonkwo ivanov petrova smith johnson brown taylor kowalski nowak al-hassan el-masri"
BOTH_WORDS = "winter rose sommer stein berg may lang klein gross august"
#: Forms of address that may stand alone, and may close a line before a name.
ADDRESS_ONLY = "frau frl hr herr herrn fr fraulein"
#: What shows that a name follows: these, families, degrees and their faculties, and the usual addresses of other languages.
_FAMILY, _DEGREES, _FACULTIES = "familie fam eheleute geschwister", "dr prof professor professorin doktor doktorin dipl mag", "ing med phil nat jur rer theol paed"
_ABROAD = "mr mrs ms mx mister miss sir madam madame monsieur mevrouw meneer signor signora senor senora pan pani bay bayan"
STRONG_TITLES = " ".join((ADDRESS_ONLY, _FAMILY, _DEGREES, _FACULTIES, _ABROAD))
#: Words for people that have a feminine form in -in, by where one meets them: school, health, law, trades, house, company.
_WITH_IN = (
    "lehrer schuler rektor direktor erzieher referendar tutor "
    "arzt pfleger therapeut apotheker sanitater hausarzt patient "
    "anwalt richter notar schoffe betreuer zeuge "
    "maler tischler elektriker installateur gartner friseur backer koch fahrer "
    "mieter vermieter nachbar hausmeister makler "
    "kollege chef leiter sachbearbeiter praktikant kunde freund"
)
ROLES = " ".join(f"{w} {w.removesuffix('e')}in" for w in _WITH_IN.split())
#: Relatives, the same people in English, and what a greeting begins with.
_KIN = "mutter vater eltern sohn tochter bruder schwester oma opa tante onkel cousin cousine mother father son daughter brother sister aunt uncle grandma grandpa"
_ENGLISH = "teacher pupil doctor nurse patient judge lawyer witness tenant landlord neighbour colleague client friend"
_GREETINGS = "hallo guten liebe lieber geehrte geehrter hello hi dear"
WEAK_TITLES = " ".join((ROLES, _KIN, _ENGLISH, _GREETINGS))
#: Titles that follow a name: Turkish and Japanese.
POST_TITLES = "bey hanim hoca abla san sensei"
#: Particles of surnames: German, Dutch, French, Italian, Spanish and Portuguese, Arabic.
PARTICLES = "von van de den der ten ter du la le di da della degli del dos y al el abu ibn bin bint"
#: Words that are no names in any spelling, by kind: articles and pronouns, verbs that serve others, joining words and
#: adverbs that often begin a sentence; German, then English.
STOP = (
    "der die das den dem des ein eine einer eines einem einen ich du er sie es wir ihr mich dich ihn uns euch man wer was "
    "ist sind war waren bin bist hat haben hatte wird werden wurde kann kam kamen muss soll will nicht "
    "und oder aber auch dass wenn als wie weil denn ob doch ja nein auf in im am an zu zum zur bei beim von vom fur uber unter nach vor seit aus mit ohne "
    "da dann dort hier heute gestern morgen jetzt nun noch nur schon so sehr immer wieder danach dabei damit daher "
    "the a an and or but of to is are was were be been has have had in on at for with by from as if not this that these those he she it we you they i then there here now so"
)
#: Articles and words that are inflected like them, by their endings, and articles merged with a preposition; then English.
_LIKE_DER = " ".join(stem + end for stem in ("dies", "jed", "jen", "welch", "manch") for end in ("e", "em", "en", "er", "es"))
_LIKE_EIN = " ".join(stem + end for stem in ("ein", "kein", "mein", "dein", "sein", "ihr", "unser") for end in ("", "e", "em", "en", "er", "es"))
DETERMINERS = f"der die das dem den des {_LIKE_DER} {_LIKE_EIN} am ans beim im ins vom zum zur a an the this that these those my your his her its our their"
#: Prepositions by the case that they take: accusative, dative, either, genitive; then English.
PREPOSITIONS = (
    "bis durch fur gegen ohne um " + "ab aus ausser bei gegenuber mit nach seit von zu " + "an auf hinter in neben uber unter vor zwischen " + "wahrend wegen trotz statt "
    "about after at before between by for from in into near of on over since to under until with without"
)
#: Weekdays and months in full, folded, and their short forms, which stand for them only with a full stop; Saturday and
#: January have two names.
CALENDAR = (
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag "
    "januar janner februar marz april mai juni juli august september oktober november dezember "
    "monday tuesday wednesday thursday friday saturday sunday january february march may june july october december"
)
WEEKDAYS_SHORT = "mo di mi do fr sa so"
MONTHS_SHORT = "jan feb marz mrz apr jun jul aug sep sept okt nov dez"
#: Cells of tables that say that there is no name (yet): signs, abbreviations, words.
FILLERS = "- -- / ? x xx n.n. nn tba leer offen fehlt unbekannt unbesetzt entfallt niemand keiner none nobody vacant"
#: Lines that close a letter; the next line is a signature.
CLOSINGS = r"^(?:mit (?:freundlichen|besten|herzlichen) grußen?|mit (?:freundlichen|besten|herzlichen) grüßen|(?:viele|liebe|beste|herzliche) grüße|hochachtungsvoll|(?:kind|best|warm) regards|yours (?:sincerely|faithfully)|sincerely) ?[,.!]?$"
#: Endings of surnames by language, without those that common words have too; a word of five letters or more with one
#: of them is shaped like a name.
SURNAME_ENDINGS = {
    "Bosnian, Croatian, Serbian": "ic",
    "Polish": "ski ska cki cka wicz czyk czak",
    "Russian, Bulgarian": "ov ova ev eva",
    "Ukrainian": "enko chuk",
    "Lithuanian": "auskas aitis",
    "Turkish": "oglu",
    "Urdu, Bengali": "ullah uddin",
    "Armenian": "yan",
    "Georgian": "dze shvili",
    "Greek": "idis akis poulos",
    "Romanian": "escu eanu",
    "Swedish, Icelandic": "sson dottir",
}
SHAPE = f"(?:{'|'.join(' '.join(SURNAME_ENDINGS.values()).split())})$"


def seed_names(spark: SparkSession) -> DataFrame:
    """(key, first, last, ambiguous) of the seeds; stop words and keys of under two letters are taken out."""
    def rows(text: str, first: bool, last: bool, ambiguous: bool) -> DataFrame:
        key = F.explode(F.split(F.lit(text), " ")).alias("key")
        return spark.range(1).select(key, F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(ambiguous).alias("ambiguous"))

    names = rows(GIVEN, True, False, False).union(rows(SURNAMES, False, True, False)).union(rows(BOTH_WORDS, False, True, True))
    return build_names(names, spark.range(1).select(F.explode(F.split(F.lit(STOP), " ")).alias("key")))


#: Cyrillic letters and what they are in Latin ones; first as in German texts, then where English ones differ.
CYRILLIC = {
    "а": "a", "б": "b", "в": "w", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "je", "ё": "jo", "ж": "sch", "з": "s", "и": "i", "і": "i", "ї": "ji", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "ch", "ц": "z", "ч": "tsch", "ш": "sch", "щ": "schtsch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "ju", "я": "ja",
}
CYRILLIC_ENGLISH = {"в": "v", "г": "g", "є": "ye", "ё": "yo", "ж": "zh", "з": "z", "ї": "yi", "й": "y", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}


def in_latin(word: Column, english: bool = False) -> Column:
    """A word in Cyrillic letters written with Latin ones, in small letters; null for a word without any."""
    table = CYRILLIC | CYRILLIC_ENGLISH if english else CYRILLIC
    single = {k: v for k, v in table.items() if len(v) < 2}
    out = F.lower(word)
    for old, new in table.items():
        if len(new) > 1:
            out = F.replace(out, F.lit(old), F.lit(new))
    # translate() takes out letters that have no counterpart: these stand last
    order = sorted(single, key=lambda k: not single[k])
    out = F.translate(out, "".join(order), "".join(single[k] for k in order))
    return F.when(word.rlike(r"\p{IsCyrillic}"), out)


def build_names(names: DataFrame, stop: DataFrame) -> DataFrame:
    """One row for each key: flags of repeated keys are united, stop words and very short keys dropped."""
    united = names.groupBy("key").agg(*[F.max(c).alias(c) for c in ("first", "last", "ambiguous")])
    return united.filter(F.char_length("key") >= 2).join(stop.select("key"), "key", "left_anti")


def name_table(sources: DataFrame, stop: DataFrame, common: DataFrame) -> DataFrame:
    """(key, first, last, ambiguous) out of lists of names: ``sources`` (name, kind, curated) with kind first, last or both.

    Names are cut at white space; hyphens, apostrophes, full stops and commas around a part go, and parts with anything but
    letters and those signs inside are left out. A part is entered by its fold, by its spelling with ae, oe and ue, and,
    if it is Cyrillic, by its two Latin spellings. Words of ``stop`` (word) are no names; keys of two letters must come from
    a ``curated`` list. ``common`` (word) are the words that are ordinary ones too. Lists of any size are one shuffle by key,
    flags are united before it.
    """
    parts = sources.select("kind", "curated", F.explode(F.split(F.trim("name"), r"[\s\x{a0}]+")).alias("part"))
    parts = parts.withColumn("part", F.regexp_replace("part", r"^[-'’]+|[-'’.,]+$", "")).filter(F.col("part").rlike(r"^[\p{L}\p{M}][\p{L}\p{M}'’-]*$"))
    spelled = F.array(F.col("part"), umlaut_variant(F.col("part")), in_latin(F.col("part")), in_latin(F.col("part"), english=True))
    keys = parts.select("kind", "curated", F.explode(F.filter(spelled, lambda x: x.isNotNull())).alias("form")).select("kind", "curated", fold(F.col("form")).alias("key"))
    first, last = F.col("kind").isin("first", "both"), F.col("kind").isin("last", "both")
    united = keys.groupBy("key").agg(F.max(first).alias("first"), F.max(last).alias("last"), F.max("curated").alias("curated"))
    size = F.char_length("key")
    held = united.filter((size > 2) | ((size == 2) & F.col("curated"))).join(stop.select(fold(F.col("word")).alias("key")).distinct(), "key", "left_anti")
    own = common.select(fold(F.col("word")).alias("key")).distinct().withColumn("ambiguous", F.lit(True))
    return held.join(own, "key", "left").select("key", "first", "last", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
