"""Personal data: base patterns, and weak supervision that adds spans: labelers vote, expectation-maximisation
weighs them, and a classifier trained on the result decides each span. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import discard, let, materialize

#: Kinds in their fixed order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "id", "name", "secret"]

#: Leftmost non-overlapping matches of the base patterns. Each pattern starts only where a run of its
#: characters starts (or where the last match ended), so long runs are not scanned again from inside, and
#: the number of digits of a card is part of the pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What only the method may add: phone numbers without a country code, numbers of identity papers, names.
LOCAL_PHONE = r"(?<![0-9A-Za-z(+])(?<![0-9+)][\x20.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])(?![\x20.-][0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Forms of address that come before a name.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
NAME = r"(?<![\p{L}0-9])(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"

#: Secrets: keys with a known beginning, and long runs of letters and digits.
KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
RUN = "A-Za-z0-9_+/-"
SECRET = rf"(?<![{RUN}])(?:(?:{KEYS})(?![{RUN}])|(?=[{RUN}]*[0-9])(?=[{RUN}]*[A-Za-z])[{RUN}]{{24,}}+={{0,2}})"

#: Words that announce each kind (the gazetteer).
CUES = {
    "email": "mail e-mail email contact address correo courriel",
    "ip": "ip address host server addr adresse",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono",
    "id": "ssn social security passport id nif dni",
    "name": "name named dear signed by von par por",
    "secret": "token secret key apikey password passwd pwd passphrase credential bearer auth passwort clave",
}
#: What registries know of a kind: forms that are assigned, and forms that never belong to someone (special
#: address blocks, numbers of one digit, reserved top-level names and area codes).
ASSIGNED = {
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})$",
    "phone": r"^(?:1[2-9][0-9]{9}|[2-9][0-9]{8,14})$",
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at)$",
    "secret": rf"^(?:{KEYS}|[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$",
}
NEVER = {
    "ip": r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.",
    "card": r"^([0-9])\1*$",
    "phone": r"^(?:0|[0-9]{3}0000000$|([0-9])\1*$)",
    "id": r"^(?:000|666|9)|^[0-9]{3}00|0000$",
}
#: Characters before a span that cues and neighbours are looked for in.
BEFORE = 24
FEATURES = 7
LABELERS = ["pattern", "gazetteer", "registry", "boundary", "numbers", "grouping"]
ROUNDS = 10
#: Matches of a text whose places are summed together.
CHUNK = 128
#: Posterior from which the classifier adds a span.
ACCEPT = 0.9


def _prefix_sums(sizes: Column) -> Column:
    """The sum of the items before each item of an array, in chunks of CHUNK: an array grows by copying, so one
    fold over all items would take the square of their number."""

    def fold(xs: Column, start: Column) -> Column:
        state = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    chunk = lambda i: F.slice(sizes, i * CHUNK + 1, CHUNK)
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), chunk)

    def chunked(parts: Column) -> Column:
        heads = fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(parts, heads, fold))

    return F.when(F.size(sizes) <= CHUNK, fold(sizes, F.lit(0))).otherwise(let(whole, chunked))


MATCHES = "array<struct<s:bigint,e:bigint,m:string,lead:string,after:string>>"


def find_all(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as structs (s: start, e: end in code points, m: the match, lead: up to BEFORE
    characters before it, from the match before it on, after: the next character).

    The matches and the text between them give all of it, so a text is not run through again for each match.
    """

    def located(ms: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: (F.length(g) + F.length(m)).cast("long"))

            def one(before: Column, i: Column) -> Column:
                gap, m, following = (F.get(x, k) for x, k in ((gaps, i), (ms, i), (gaps, i + 1)))
                start = before + F.length(gap)
                lead = F.right(F.concat(F.coalesce(F.get(ms, i - 1), F.lit("")), gap), F.lit(BEFORE))
                after = F.left(F.concat(F.left(following, F.lit(1)), F.coalesce(F.left(F.get(ms, i + 1), F.lit(1)), F.lit(""))), F.lit(1))
                return F.struct(start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"), lead.alias("lead"), after.alias("after"))

            return let(_prefix_sums(steps), lambda sums: F.transform(sums, one))

        return let(F.split(text, pattern, -1), placed).cast(MATCHES)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda ms: F.when(F.size(ms) > 0, located(ms)).otherwise(F.array().cast(MATCHES)),
    )


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a match pass the Luhn check."""

    def total(r: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.substring(r, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0

    return let(F.reverse(digits(m)), total)


def octets(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.(?!$)|$)){4}$")


def _spans(text: Column) -> Column:
    """Every match of every pattern with ``base`` (it is personal data by the base rules)."""

    def some(kind: str, pattern: str, base, when: Column | None = None) -> Column:
        found = F.transform(
            find_all(text, pattern),
            lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), *[x[c].alias(c) for c in ("s", "e", "m", "lead", "after")], base(x["m"]).alias("base")),
        )
        none = F.array().cast(MATCHES.replace("<s:", "<k:int,s:").replace("after:string", "after:string,base:boolean"))
        return found if when is None else F.when(when, found).otherwise(none)

    numbers = text.rlike("[0-9]{2}")
    n = lambda m: F.length(digits(m))
    return F.concat(
        some("email", EMAIL, lambda m: F.lit(True), F.contains(text, F.lit("@"))),
        some("ip", IP, octets, text.rlike(r"[0-9]\.[0-9]")),
        some("card", CARD, luhn, numbers),
        some("phone", PHONE, lambda m: n(m).between(9, 15), F.contains(text, F.lit("+"))),
        some("phone", LOCAL_PHONE, lambda m: F.lit(False), numbers),
        some("id", IDENTITY, lambda m: F.lit(False), text.rlike("[0-9]-[0-9]")),
        some("name", NAME, lambda m: F.lit(False), text.rlike("|".join(TITLES))),
        some("secret", SECRET, lambda m: F.lit(False), text.rlike(f"[{RUN}]{{20}}")),
    )


def _judged(spans: Column) -> Column:
    """Each span with the votes of the labelers (1 for, -1 against, 0 none) and the classifier's features."""

    def one(x: Column) -> Column:
        after = x["after"]

        def votes(lead: Column) -> Column:
            cue = F.lit(False)
            for k, kind in enumerate(KINDS):
                said = r"(?:^|[^\p{L}])(?:" + "|".join(CUES[kind].split()) + r")[^\p{L}]{1,4}(?:\p{L}{1,3}[^\p{L}]{1,3})?$"
                cue = cue | ((x["k"] == k) & lead.rlike(said))
            separators = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(x["m"], r"[0-9\p{L}@%_+]", ""), ""), lambda c: c != "")))
            form = F.when(x["k"].isin(2, 3), digits(x["m"])).otherwise(x["m"])
            known, never = F.lit(False), F.lit(False)
            for table, kinds in ((ASSIGNED, "known"), (NEVER, "never")):
                said = F.lit(False)
                for kind, pattern in table.items():
                    said = said | ((x["k"] == KINDS.index(kind)) & form.rlike(pattern))
                known, never = (said, never) if kinds == "known" else (known, said)
            secret = x["k"] == KINDS.index("secret")
            vote = {
                "pattern": F.when(x["base"], 1).when(x["k"].isin(0, 1, 2), -1).otherwise(0),
                "gazetteer": F.when(cue | (x["k"] == KINDS.index("name")), 1).otherwise(0),
                "registry": F.when(never, -1).when(known, 1).otherwise(0),
                "boundary": F.when(secret, 0).when(lead.rlike(r"[\p{L}0-9_/=#]$") | after.rlike(r"^[\p{L}0-9_/=#]"), -1).otherwise(1),
                "numbers": F.when(lead.rlike(r"[0-9][^\p{L}]{0,3}$"), -1).otherwise(0),
                "grouping": F.when(x["k"].isin(0, 1, 5, 6), 0).when(separators <= 2, 1).otherwise(-1),
            }
            size = F.least(F.length(x["m"]) / 4, F.lit(6)).cast("int")
            near = F.when(lead == "", 0).when(lead.rlike(r"[\x20\n]$"), 1).when(lead.rlike(r"\p{L}$"), 2).when(lead.rlike("[0-9]$"), 3).otherwise(4)
            features = F.concat_ws(
                "|", x["k"].cast("string"), x["base"].cast("string"), cue.cast("string"), size.cast("string"), near.cast("string"), F.least(separators, F.lit(3)).cast("string"),
                F.when(never, "never").when(known, "known").otherwise(""),
            )
            return F.struct(
                x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"),
                F.concat_ws(",", *[vote[v].cast("string") for v in LABELERS]).alias("votes"), features.alias("features"),
            )

        return let(F.lower(x["lead"]), votes)

    return F.transform(spans, one)


def learn_labelers(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over the vote patterns ``(votes, n)``, at most 3^6 rows: the share of true spans, and for each labeler
    and vote its probability given a true and given a false span."""
    prior, given = 0.5, [{1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for _ in LABELERS]
    vote = F.split("votes", ",")
    sums = [F.sum("yes").alias("yes"), F.sum("n").alias("all")]
    for i in range(len(LABELERS)):
        for v in (-1, 0, 1):
            hit = F.col("vote")[i] == str(v)
            sums += [F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0.0))).alias(f"{k}{i}{v}") for k, c in (("t", "yes"), ("f", "no"))]
    for _ in range(rounds):
        p = posterior(F.col("vote"), prior, given)
        weighed = patterns.withColumn("vote", vote).withColumn("p", p)
        weighed = weighed.select("n", "vote", (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
        got = weighed.agg(*sums).first()
        if not got["all"]:
            break
        yes, no = got["yes"], got["all"] - got["yes"]
        prior = (yes + 1) / (got["all"] + 2)
        given = [{v: ((got[f"t{i}{v}"] + 1) / (yes + 3), (got[f"f{i}{v}"] + 1) / (no + 3)) for v in (-1, 0, 1)} for i in range(len(LABELERS))]
    return prior, given


def posterior(vote: Column, prior: float, given: list[dict[int, tuple[float, float]]]) -> Column:
    """Probability that a span with these votes is true."""
    true, false = F.lit(prior), F.lit(1 - prior)
    for i, table in enumerate(given):
        for side in (0, 1):
            x = F.when(vote[i] == "1", table[1][side]).when(vote[i] == "-1", table[-1][side]).otherwise(table[0][side])
            true, false = (true * x, false) if side == 0 else (true, false * x)
    return true / (true + false)


def train_classifier(found: DataFrame, prior: float, given: list[dict[int, tuple[float, float]]]) -> list[dict[str, tuple[float, float]]]:
    """Naive Bayes over the features of the spans ``(votes, features, n)``, with the posteriors as soft labels:
    for each feature (the kind first, as the class prior) and value the two log probabilities."""
    p = posterior(F.split("votes", ","), prior, given)
    parts = F.posexplode(F.split("features", r"\|")).alias("i", "value")
    rows = found.withColumn("p", p).select("n", "p", parts).groupBy("i", "value").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    table: list[dict[str, tuple[float, float]]] = [{} for _ in range(FEATURES)]
    for r in rows.collect():  # values of six small features: some tens of rows
        table[r.i][r.value] = (r.yes, r.no)
    return table


def classify(features: Column, table: list[dict[str, tuple[float, float]]]) -> Column:
    """Probability of a span by the trained table; unseen values count as rare on both sides."""
    import math

    if not table[0]:
        return F.lit(0.0)
    yes, no = (sum(v[s] for v in table[0].values()) for s in (0, 1))
    score = F.lit(math.log((yes + 1) / (no + 1)))
    for i, values in enumerate(table):
        k = len(values) + 1
        odds = {v: math.log((y + 0.5) / (yes + 0.5 * k)) - math.log((n + 0.5) / (no + 0.5 * k)) for v, (y, n) in values.items()}
        pairs = [F.lit(x) for kv in odds.items() for x in kv]
        score = score + F.coalesce(F.try_element_at(F.create_map(*pairs), features[i]), F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Personal data of every document: id, base (spans found by the base patterns) and spans (these and those the
    trained classifier adds), arrays of (s, k, e): start, number of the kind in KINDS, end (exclusive), in code points.

    The texts are read once; candidates with their votes and features are written next to the id, the
    models are learned from counts of vote and feature patterns (bounded by the number of
    patterns), and the verdicts are a projection. A match that the base rules refuse is not added. Null and empty
    texts have no spans; null ids and repeated rows pass through; other columns are not read; an empty table gives
    an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(
        narrow.select("id", let(_spans(text), lambda s: F.when(F.size(s) > 0, _judged(s))).alias("found")), "spans"
    )
    seen = found.select(F.explode("found").alias("x")).groupBy("x.votes", "x.features").agg(F.count("*").alias("n"))
    seen = materialize(seen, "patterns")
    patterns = seen.groupBy("votes").agg(F.sum("n").alias("n"))
    prior, given = learn_labelers(patterns)
    table = train_classifier(seen, prior, given)
    discard(seen)
    plain = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    base = F.filter("found", lambda x: x["base"])
    covered = lambda x: F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    refused = lambda x: x["k"].isin(KINDS.index("ip"), KINDS.index("card"))
    added = F.filter("found", lambda x: ~x["base"] & ~refused(x) & (classify(F.split(x["features"], r"\|"), table) >= accept) & ~covered(x))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce(plain(base), none).alias("base"),
        F.coalesce(plain(F.concat(base, added)), none).alias("spans"),
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["k"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
