"""Column expressions that tell whether a title names a work. All work on arrays of normalised tokens, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_diacritics, tokens

# Articles, words of packaging, technical words that end a work's name, and words that say nothing about it.
ARTICLES = "o a os as um uma uns umas the an el la los las un una unos unas le les une des il lo gli uno der die das den dem ein eine einen het een".split()
PACK_WORDS = "colecao coletanea trilogia saga duologia quadrilogia pentalogia antologia filmes serie series temporada temporadas todas todos completa completo integral collection complete movies films".split()
STRONG_PACK_WORDS = "trilogia duologia quadrilogia pentalogia colecao coletanea antologia filmografia filmography trilogy quadrilogy duology tetralogy anthology boxset".split()
TECHNICAL = (
    "web dl webdl bluray blu ray webrip bdrip brrip hdtv hdrip rip remux hybrid x264 x265 h264 h265 avc hevc av1 xvid divx 10bit 8bit hdr hdr10 dv sdr imax "
    "dts aac ac3 eac3 ddp ddp5 ddp2 dd atmos truehd opus mp3 dual audio nacional multi hmax amzn dsnp atvp pcok crav hulu h us uk ca au nz jp tv "
    "torrent torrents download baixar assistir online gratis dublado dublada dublagem legendado legendada legenda opcao opcoes versao estendida extendida "
    "mkv mp4 avi gb mb kb 480p 540p 576p 720p 1080p 1440p 2160p 4k uhd sd hd fullhd"
).split()
SILENT = "de do da das dos e a o os as um uma em no na para por com sobre ate portugues portuguesa portugueses brasil brasileiro brasileira derew www thepiratefilmes".split()
NUMBER_WORDS = {
    "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "dois": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
# Least precision of films and of series, least coverage of a name, years that a film and a series may be off.
FILM_PRECISION, SERIES_PRECISION, COVERAGE, YEARS_OFF = 0.65, 0.70, 0.6, 2

YEAR = "^(19|20)[0-9]{2}$"
MARKER = "^([st][0-9]{1,2}(e[0-9]{1,3})?|e[0-9]{1,3}|[0-9]{1,2}x[0-9]{1,3}|[0-9]{1,2}a)$"
EPISODE_CODE = "^(s[0-9]{1,2}e[0-9]{1,3}|[0-9]{1,2}x[0-9]{1,3})$"


def _in(words: list[str]):
    return lambda t: t.isin(*words)


def wanted_tokens(name: Column) -> Column:
    """Sorted distinct tokens of a name that count: those of more than two letters that are no article, or all if fewer than two are."""
    telling = F.filter(name, lambda t: (F.length(t) > 2) & ~_in(ARTICLES)(t))
    return F.array_sort(F.array_distinct(F.when(F.size(telling) >= 2, telling).otherwise(name)))


def leading_token(tokens: Column) -> Column:
    """The first token that is neither short nor an article, packaging or an episode's mark; else the first."""
    telling = F.filter(tokens, lambda t: (F.length(t) > 2) & ~_in([*ARTICLES, *PACK_WORDS])(t) & ~t.rlike(MARKER))
    return F.coalesce(F.get(telling, F.lit(0)), F.get(tokens, F.lit(0)))


def sequence_markers(tokens: Column) -> Column:
    """Numbers from 2 to 19, in digits or words, before the first year, technical or packaging word."""
    stops = F.transform(tokens, lambda t, i: F.when(t.rlike(YEAR) | _in([*TECHNICAL, *PACK_WORDS])(t), i))
    head = F.slice(tokens, 1, F.coalesce(F.array_min(stops), F.size(tokens)))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    numbers = F.transform(head, lambda t: F.when(t.rlike("^[0-9]{1,6}$"), t.cast("int")).otherwise(F.element_at(words, t)))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(2, 19)))


def telling_tokens(tokens: Column) -> Column:
    """Tokens that say something about a work: no release noise, packaging, marks or bare numbers."""
    return F.filter(tokens, lambda t: ~_in([*TECHNICAL, *SILENT, *PACK_WORDS, *STRONG_PACK_WORDS])(t) & ~t.rlike(MARKER) & ~t.rlike("^[0-9]+$"))


def title_precision(telling: Column, universe: Column) -> Column:
    """Share of a title's telling tokens that some name of the work holds; 1 if there are none."""
    return F.when(F.size(telling) == 0, 1.0).otherwise(F.size(F.filter(telling, lambda t: F.array_contains(universe, t))) / F.size(telling))


def work_part(tokens: Column) -> Column:
    """The tokens that name the work in a title with an episode's code: those before it, or behind it if it comes first, up to the next code or, without one, the first technical word. Null without a code."""
    code = F.transform(tokens, lambda t, i: F.when(t.rlike(EPISODE_CODE) | (t.rlike("^t[0-9]{1,2}$") & F.coalesce(F.get(tokens, i + 1).rlike("^e[0-9]{1,3}$"), F.lit(False))), i))
    codes = F.array_compact(code)
    first, second = F.get(codes, F.lit(0)), F.get(codes, F.lit(1))
    noise = F.array_min(F.transform(tokens, lambda t, i: F.when((i > 0) & _in([*TECHNICAL, *PACK_WORDS])(t), i)))
    end = F.coalesce(second, noise, F.size(tokens))
    return F.when(first > 0, F.slice(tokens, 1, first)).when(first == 0, F.slice(tokens, 2, F.greatest(end - 1, F.lit(0))))


def years_of(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: t.rlike(YEAR)), lambda t: t.cast("int"))


def year_contradicts(years: Column, year: Column, is_series: Column) -> Column:
    """One year in a film's title that is too far off, or a series' title whose years are all too early. An unknown year contradicts nothing."""
    early = (F.size(years) > 0) & F.forall(years, lambda y: y < year - YEARS_OFF)
    off = (F.size(years) == 1) & (F.abs(F.get(years, F.lit(0)) - year) > YEARS_OFF)
    return F.coalesce(F.when(is_series, early).otherwise(off), F.lit(False))


def magnet_years(magnet: Column) -> Column:
    """Distinct years in the display name of a magnet link; resolutions are no years. Other links and none: empty."""
    shown = F.regexp_extract(magnet, "(?i)^magnet:.*?[&?]dn=([^&]+)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(shown, F.lit("+"), F.lit("%20"))), shown)
    plain = F.regexp_replace(plain, "[0-9]{3,4}[xX][0-9]{3,4}", " ")
    found = F.regexp_extract_all(plain, F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, lambda y: y.cast("int"))), F.array().cast("array<int>"))


def is_multi_work(tokens: Column) -> Column:
    """The title is a collection: a word that says so, or a word of packaging beside a range of years (two years in a row, or with a small word between)."""
    year = lambda i: F.coalesce(F.get(tokens, i).rlike(YEAR), F.lit(False))
    link = lambda i: F.coalesce(_in(["de", "a", "ate"])(F.get(tokens, i)), F.lit(False))
    ranges = F.exists(F.transform(tokens, lambda t, i: t.rlike(YEAR) & (year(i + 1) | (link(i + 1) & year(i + 2)))), lambda x: x)
    return F.exists(tokens, _in(STRONG_PACK_WORDS)) | (ranges & F.exists(tokens, _in(PACK_WORDS)))


# Numerals of sequels that sites write either way.
ROMAN = {"II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9"}
_NUMERAL = r"(?<![\p{L}\p{N}])(?:VIII|VII|IV|III|IX|VI|II|V)(?![\p{L}\p{N}])"


def search_query(name: Column, year: Column, season: Column, episode: Column) -> Column:
    """What a source is asked for: the name with the episode's code, or else with the year, as far as they are known."""
    code = F.format_string("S%02dE%02d", season.cast("int"), episode.cast("int"))
    end = F.when(season.isNotNull() & episode.isNotNull(), code).otherwise(F.substring(year.cast("string"), 1, 4))
    return F.trim(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(end, F.lit(""))))


def numeral_variant(query: Column) -> Column:
    """The query with its only Roman numeral of a sequel in digits; null without one, with several, or where nothing but articles stands before it."""
    found = F.regexp_extract_all(query, F.lit(_NUMERAL), F.lit(0))
    before = tokens(F.regexp_extract(query, f"(?s)^(.*?){_NUMERAL}", 1))
    digit = F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), F.get(found, F.lit(0)))
    return F.when((F.size(found) == 1) & F.exists(before, lambda t: ~t.isin(*ARTICLES)), F.regexp_replace(query, F.lit(_NUMERAL), digit))


def shape_query(query: Column, priority: Column, bare: Column) -> Column:
    """A query as a source takes it: sources of priority get neither an episode's code nor marks on letters, ``bare`` ones no year at the end; never empty."""
    plain = F.when(priority, strip_diacritics(F.regexp_replace(query, r"(?i)\bS\d{1,2}(?:E\d{1,3})?\b", " "))).otherwise(query)
    short = F.when(bare, F.regexp_replace(plain, r"\s+(?:19|20)\d{2}\s*$", " ")).otherwise(plain)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(short, r"\s+", " ")), F.lit("")), query)


def namespace_of(key: Column) -> Column:
    """What stands before a key's first colon."""
    return F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", 1)).otherwise("__default")


def link_identity(url: Column) -> Column:
    """Ten hex digits that name a link wherever it stands in its post."""
    return F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 10)
