"""The lexicon of the name rules: entries of one to three words, each with its classes.

It is data, not code. The entries below are a small lexicon of its own; pass other sets, a table (token, class),
or a stored version wherever it is used. A table of up to a million rows can travel with the tasks (``from_table``). A
larger one never does: ``with_classes`` meets the entries with the words of the documents in joins, and gives
each document a map of just the entries that its own words can make.

Classes: ``given`` and ``surname`` (one of several words is a compound surname, also found if written as one word),
``common`` (never part of a name by itself), ``entity`` (makes a run of capitalised words an organisation), ``site`` (in
front of a name it says: a building, an event or a place named after someone), ``place`` (entries of several words that are
no person though one of their words is a given name), ``particle``, ``article``, ``qualifier``, ``acronym`` (institutions, only in capitals),
``ambiguous`` (a name that is also a word, no evidence when alone), ``job``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _entries(text: str) -> frozenset[str]:
    return frozenset(" ".join(x.split()) for x in text.split(","))


GIVEN = _words(
    "anna maria giulia sara laura chiara elena paola francesca marta lucia silvia rosa angela alice emilia valentina martina federica "
    "giovanna teresa caterina carla daniela monica cristina barbara claudia simona roberta patrizia antonella raffaella ilaria elisa irene "
    "beatrice ludovica margherita carolina virginia viola "
    "marco luca giovanni paolo andrea matteo giuseppe antonio francesco stefano roberto davide simone carlo pietro mario luigi fabio enrico "
    "giorgio walter umberto vittorio emanuele leonardo nazzareno alessandro lorenzo filippo gabriele tommaso riccardo nicola vincenzo salvatore "
    "domenico michele raffaele claudio maurizio massimo sergio franco bruno gianluca gianni renato aldo ugo ettore cesare nino "
    "john james mary robert michael linda william david elizabeth richard susan joseph thomas charles sarah karen nancy peter emma oliver "
    "harry george emily jane paul mark daniel andrew edward henry alexander charlotte sophia jessica rachel hannah laurie kevin brian "
    "hans klaus ursula heike jürgen pierre jacques claire sophie juan carlos carmen josé pilar lucía pedro miguel"
)

SURNAMES = _words(
    "rossi russo ferrari esposito bianchi romano colombo ricci marino greco bruno gallo conti costa giordano mancini rizzo lombardi moretti "
    "barbieri fontana santoro mariani rinaldi caruso ferrara galli martini leone longo gentile martinelli vitale lombardo serra villa messina "
    "verdi neri gatti pellegrini palumbo sanna farina rizzi monti cattaneo morelli amato silvestri mazza testa grassi pellegrino carbone "
    "giuliani benedetti barone orlando damico palmieri bernardi marchetti sala ruggiero coppola deluca dangelo desantis disalvo dipietro dimaio "
    "delpiero lobianco delvecchio dinatale napoli catania brescia marchi basile bellini parisi valentini negri "
    "smith jones taylor brown williams wilson johnson davies robinson wright thompson evans walker white roberts green hall wood jackson clarke "
    "harris lewis martin cooper king baker turner hill moore parker whitfield bennett carter morgan hughes edwards "
    "müller schmidt schneider fischer weber meyer dubois durand lefebvre moreau garcía martínez lópez fernández gonzález"
)

#: Compound surnames that are not just a particle and a listed word.
COMPOUNDS = _entries("della valle, dalla chiesa, de la cruz, van der berg, von der leyen, lo presti, la rosa, del monte, degli esposti, li causi")

COMMON = _words(
    "il lo la gli le un una dal del della dei delle con per tra fra che non come quando dove ogni questo questa quello gentile egregio spett "
    "cordiali distinti saluti oggetto data luogo ufficio comune tribunale banca studio società via piazza viale corso presidente direttore "
    "di da de in se ma ed al alla nel nella sul sulla dallo dalla dello degli riferimento cliente imposta lorda netta totale legale conti villa "
    "messina napoli catania brescia ferrara costa sala testa farina monti vecchio natale valle porta "
    "oggi ieri domani qui ora poi ho ha è sono arriva scrive chiede firmato visto fascicolo pratica allegato protocollo scadenza importo numero "
    "codice cognome nome indirizzo telefono buongiorno salve caro cara grazie signor signora dottor dottoressa avvocato ingegnere "
    "today yesterday here there we he she they it is was please thanks hello hi invoice order number name address phone customer client "
    "the a an and or of to in on at by for from with this that these those dear regards sincerely yours subject date office bank street road "
    "president director january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre"
)

#: Words that make a run of capitalised words an organisation or a place.
ENTITY = _words(
    "spa srl sas snc ltd llc inc plc gmbh ag sa group holding università ospedale istituto scuola liceo ministero regione provincia "
    "university hospital institute school ministry county department council church teatro museo museum stadio aeroporto airport "
    "chiesa parrocchia diocesi fondazione associazione federazione consorzio cooperativa azienda agenzia policlinico clinica biblioteca "
    "conservatorio accademia politecnico caserma basilica cattedrale abbazia monastero ambasciata consolato prefettura questura procura "
    "logistics solutions services systems partners trust consulting foundation association library academy college cathedral abbey embassy agency authority committee commission union federation"
)

SITES = _words(
    "san santa santo sant saint st ponte palazzo palazzetto torre villa parco giardino centro polo casa hotel albergo ristorante trattoria "
    "sala aula cappella monumento statua fontana nave traghetto quartiere rione frazione borgo contrada località zona via viale piazza corso "
    "largo vicolo premio torneo trofeo concorso borsa coppa medaglia pizza torta gelato uscita casello svincolo autostrada diga lago monte "
    "nord sud est ovest north south east west new bridge tower park hall house prize award cup street road avenue square"
)

PLACES = _entries(
    "venezia giulia, friuli venezia giulia, emilia romagna, reggio emilia, rocca di papa, sala consilina, torre annunziata, villa san giovanni, "
    "santa maria, san giovanni rotondo, porto viro, castel gandolfo, val di susa, west virginia, north carolina, south carolina, los angeles, san francisco"
)

PARTICLES = _words("di de del dello della delle dei degli da dal dalla dallo dagli lo la li lu van von der den ter le")
ARTICLES = _words(
    "il lo la i gli le un uno una l dell all nell sull dall del dello della dei degli delle al allo alla ai agli alle nel nello nella nei negli "
    "nelle dal dallo dalla dai dagli dalle sul sullo sulla sui sugli sulle di a da in su con per tra fra e the of at in to and"
)
QUALIFIERS = _words(
    "nazionale statale comunale provinciale regionale civico civica municipale primaria secondaria elementare media superiore comprensivo classico "
    "scientifico artistico tecnico professionale sportivo militare generale centrale maggiore vecchio nuovo nuova storico storica antico antica "
    "civile grande national royal central general primary secondary old new great"
)
ACRONYMS = _words("ic ics iis iiss itis itc ipsia its cpia asl asp ausl usl irccs scmedia nhs hmp")
AMBIGUOUS = _words("rosa viola margherita costa villa sala monte monti marina gloria vittoria speranza grazia franco massimo serena will mark grace hope may june april king hill wood green white brown baker")
JOBS = _words(
    "architect architetto manager engineer ingegnere director direttore officer analyst analista consultant consulente developer sviluppatore "
    "specialist specialista lead head chief founder partner advisor coordinator coordinatore supervisor administrator amministratore designer "
    "progettista scientist researcher ricercatore responsabile dirigente titolare presidente segretario"
)

#: Bits of the classes, in the order of the fields of ``Lexicon``.
CLASSES = ("given", "surname", "common", "entity", "site", "place", "particle", "article", "qualifier", "acronym", "ambiguous", "job")
BIT = {name: 1 << i for i, name in enumerate(CLASSES)}
#: Words of the longest entry that is looked up.
LONGEST = 3


@dataclass(frozen=True)
class Lexicon:
    given: frozenset[str] = GIVEN
    surnames: frozenset[str] = SURNAMES | COMPOUNDS
    common: frozenset[str] = COMMON
    entity: frozenset[str] = ENTITY
    sites: frozenset[str] = SITES
    places: frozenset[str] = PLACES
    particles: frozenset[str] = PARTICLES
    articles: frozenset[str] = ARTICLES
    qualifiers: frozenset[str] = QUALIFIERS
    acronyms: frozenset[str] = ACRONYMS
    ambiguous: frozenset[str] = AMBIGUOUS
    jobs: frozenset[str] = JOBS

    @classmethod
    def from_table(cls, table: DataFrame, most: int = 1_000_000) -> Lexicon:
        """From rows (token, class); a table above ``most`` rows is an error, since it travels with the tasks.

        Classes that the table does not have stay as they are in the lexicon of this module."""
        rows = table.select("token", "class").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the lexicon has more than {most} rows")
        sets: dict[str, set[str]] = {}
        for token, kind in rows:
            if kind not in BIT:
                raise ValueError(f"unknown class: {kind}")
            if token:
                sets.setdefault(kind, set()).add(" ".join(token.lower().split()))
        return cls(**{f.name: frozenset(sets[kind]) for f, kind in zip(fields(cls), CLASSES, strict=True) if kind in sets})

    def bits(self) -> dict[str, int]:
        """Entry to the bits of its classes."""
        found: dict[str, int] = {}
        for f, kind in zip(fields(self), CLASSES, strict=True):
            for entry in getattr(self, f.name):
                found[entry] = found.get(entry, 0) | BIT[kind]
        return found


def table(spark: SparkSession, lexicon: Lexicon | None = None) -> DataFrame:
    """The lexicon as rows (token, class)."""
    x = lexicon or Lexicon()
    rows = [(t, kind) for f, kind in zip(fields(x), CLASSES, strict=True) for t in sorted(getattr(x, f.name))]
    return spark.createDataFrame(rows, "token string, class string")


def store_version(entries: DataFrame, path: str, version: int) -> None:
    """Keep rows (token, class) as one version of the lexicon in ``path``; a version that is there already is an error."""
    entries.select("token", "class").distinct().write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(token, class) of one version kept in ``path``, by default the last."""
    kept = spark.read.schema("token string, class string, version int").option("basePath", path).parquet(path)
    last = kept.agg(F.max("version")).first()[0] if version is None else version
    return kept.filter(F.col("version") == last).select("token", "class")


def entry_bits(entries: DataFrame) -> DataFrame:
    """(entry, bits): one row for each entry of a table (token, class), in lower case with single blanks."""
    kinds = F.create_map(*[F.lit(x) for pair in BIT.items() for x in pair])
    named = entries.select(F.lower(F.btrim(F.regexp_replace("token", r"\s+", " "))).alias("entry"), kinds[F.col("class")].alias("bit"))
    return named.filter("entry != '' AND bit IS NOT NULL").groupBy("entry").agg(F.bit_or("bit").alias("bits"))


#: A word for the lexicon: letters, inner apostrophes and hyphens.
WORD = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"
#: At most this many entries are sent to all tasks, those that the most documents have.
HEAVY = 100_000


def candidates(text, longest: int = LONGEST):
    """Distinct strings of a text that an entry may equal: words, their parts at apostrophes, runs of two to ``longest`` words, and two words as one."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.get(F.transform(F.array(words), lambda w: _joined(w, longest)), F.lit(0))


def _joined(w, longest: int):
    def run(n: int):
        return F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))

    runs = [run(n) for n in range(2, longest + 1)]
    glued = F.transform(w, lambda x, i: F.concat(x, F.get(w, i + 1)))
    parts = F.flatten(F.transform(F.filter(w, lambda x: x.rlike("['’]")), lambda x: F.array_append(F.split(x, "['’]"), F.regexp_replace(x, "['’]", ""))))
    return F.array_distinct(F.filter(F.concat(w, parts, *runs, glued), lambda x: x.isNotNull() & (x != "")))


def with_classes(docs: DataFrame, key: str, text: str, entries: DataFrame, into: str = "lexicon", longest: int = LONGEST) -> DataFrame:
    """``docs`` with the map ``into``: entry to class bits, of the entries of the lexicon table that the text can hold.

    A lexicon of at most ``HEAVY`` entries is broadcast, so that only pairs with an entry are ever shuffled. Of a larger one, which may hold
    millions, both sides are shuffled by entry. An entry that
    very many documents have would be a hot key there: at most ``HEAVY`` entries can be in more than one of ``HEAVY`` parts of
    all (document, entry) pairs, and they alone are broadcast. Rows that share a key share their entries, a null key
    is a key like others, a text without entries (or null) has an empty map.
    """
    pairs = docs.select(F.col(key).alias("k"), F.explode(candidates(F.col(text), longest)).alias("entry"))
    listed = written(entry_bits(entries), "bits")
    if listed.limit(HEAVY + 1).count() <= HEAVY:
        met = pairs.join(F.broadcast(listed), "entry")
    else:
        facts = written(pairs.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).join(listed, "entry"), "entries")
        total = facts.agg(F.sum("n")).first()[0] or 0
        most = max(1000, total // HEAVY)
        heavy, light = facts.filter(F.col("n") > most).select("entry", "bits"), facts.filter(F.col("n") <= most).select("entry", "bits")
        met = pairs.join(F.broadcast(heavy), "entry").unionByName(pairs.join(F.broadcast(heavy.select("entry")), "entry", "left_anti").join(light, "entry"))
    # a document has no more entries than its text has words
    maps = met.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("entry", "bits"))).alias("_entries"))
    none = F.create_map().cast("map<string,int>")
    joined = docs.alias("_d").join(maps.alias("_m"), F.col(f"_d.{key}").eqNullSafe(F.col("_m.k")), "left")
    return joined.select("_d.*", F.coalesce("_m._entries", none).alias(into))
