"""Queries of the syntax-tree constructors: every overload, built by the grammar, against its tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexloom.functions import constructors

QUERIES: dict = {}
ORACLES: dict = {}

# The trees of the overloads, as ``constructor: categories = tree``, where $1 is the
# first argument; alternatives stand behind a bar, the default first. What follows a rule is below.
TREES = """
mkPhr: PConj Utt Voc = PhrUtt $1 $2 $3
mkPhr: PConj Utt Voc Mark = PhrUttMark $1 $2 $3 $4
mkPhr: Utt Voc = PhrUtt NoPConj $1 $2
mkPhr: Utt Voc Mark = PhrUttMark NoPConj $1 $2 $3
mkPhr: PConj Utt = PhrUtt $1 $2 NoVoc
mkPhr: PConj Utt Mark = PhrUttMark $1 $2 NoVoc $3
mkPhr: Utt = PhrUtt NoPConj $1 NoVoc
mkPhr: Utt Mark = PhrUttMark NoPConj $1 NoVoc $2
mkPhr: S = PhrUtt NoPConj (UttS $1) NoVoc
mkPhr: Cl = PhrUtt NoPConj (UttS (UseCl (TTAnt TPres ASimul) PPos $1)) NoVoc
mkPhr: QS = PhrUtt NoPConj (UttQS $1) NoVoc
mkPhr: Imp = PhrUtt NoPConj (UttImpSg PPos $1) NoVoc
mkPhrMark: S = PhrUttMark NoPConj (UttS $1) NoVoc FullStop
mkPhrMark: Cl = PhrUttMark NoPConj (UttS (UseCl (TTAnt TPres ASimul) PPos $1)) NoVoc FullStop
mkPhrMark: QS = PhrUttMark NoPConj (UttQS $1) NoVoc QuestMark
mkPhrMark: Imp = PhrUttMark NoPConj (UttImpSg PPos $1) NoVoc ExclMark
mkPConj: Conj = PConjConj $1
mkVoc: NP = VocNP $1
mkUtt: S = UttS $1
mkUtt: Cl = UttS (UseCl (TTAnt TPres ASimul) PPos $1)
mkUtt: QS = UttQS $1
mkUtt: QCl = UttQS (TUseQCl TPres ASimul PPos $1)
mkUtt: Pol Imp = UttImpSg $1 $2
mkUtt: Imp = UttImpSg PPos $1
mkUtt: IP = UttIP $1
mkUtt: IAdv = UttIAdv $1
mkUtt: NP = UttNP $1
mkUtt: Adv = UttAdv $1
mkUtt: VP = UttVP $1
mkUtt: CN = UttCN $1
mkUtt: AP = UttAP it_Pron $1
mkUtt: Pron AP = UttAP $1 $2
mkUtt: Card = UttCard $1
lets_Utt: VP = ImpPl1 $1
mkTemp: Tense Ant = TTAnt $1 $2
mkS: Conj S S = ConjS $1 (BaseS $2 $3)
mkS: Conj ListS = ConjS $1 $2
mkS: Adv S = AdvS $1 $2
mkCl: N = ExistNP (DetCN (DetQuant IndefArt NumSg) (UseN $1))
mkCl: CN = ExistNP (DetCN (DetQuant IndefArt NumSg) $1)
mkCl: NP = ExistNP $1
mkCl: NP RS = CleftNP $1 $2
mkCl: Adv S = CleftAdv $1 $2
mkCl: V = ImpersCl (UseV $1)
mkCl: VP = ImpersCl $1
mkCl: SC VP = PredSCVP $1 $2
genericCl: VP = GenericCl $1
mkVP: V2 NP = ComplSlash (SlashV2a $1) $2
mkVP: VV Ant Pol VP = ComplVV $1 $2 $3 $4
mkVP: VP Adv = AdvVP $1 $2
mkVP: AdV VP = AdVVP $1 $2
mkVP: VPSlash = ReflVPSlash $1 ReflPron
mkVP: Comp = UseComp $1
mkVP': VP Adv = $1 | AdvVP $1 $2
mkVP': AdV VP = $2 | AdVVP $1 $2
mkVPS: Conj VPS VPS = ConjVPS $1 (BaseVPS $2 $3)
mkVPS: Conj ListVPS = ConjVPS $1 $2
reflexiveVP: V2 = ReflVPSlash (SlashV2a $1) ReflPron
reflexiveVP: VPSlash = ReflVPSlash $1 ReflPron
passiveVP: V2 = PassVPSlash (SlashV2a $1)
passiveVP: V2 NP = PassAgentVPSlash (SlashV2a $1) $2
passiveVP: VPSlash = PassVPSlash $1
passiveVP: VPSlash NP = PassAgentVPSlash $1 $2
progressiveVP: VP = ProgrVP $1
mkComp: AP = CompAP $1
mkComp: NP = CompNP $1
mkComp: Adv = CompAdv $1
mkSC: S = EmbedS $1
mkSC: QS = EmbedQS $1
mkSC: Ant Pol Pron VP = EmbedVP $1 $2 $3 $4
mkImp: VP = ImpVP $1
mkImp: V = ImpVP (UseV $1)
mkImp: V2 NP = ImpVP (ComplV2 $1 $2)
mkNP: Quant Num Ord CN = DetCN (DetQuantOrd $1 $2 $3) $4
mkNP: Num Ord CN = DetCN (DetQuantOrd IndefArt $1 $2) $3
mkNP: Numeral Ord N = DetCN (DetQuantOrd IndefArt (NumCard (NumNumeral $1)) $2) (UseN $3)
mkNP: PN = UsePN $1
mkNP: LN = UseLN $1
mkNP: Pron = UsePron $1
mkNP: Quant = UseDAP (DetDAP (DetQuant $1 NumSg))
mkNP: Quant Num = UseDAP (DetDAP (DetQuant $1 $2))
mkNP: Det = UseDAP (DetDAP $1)
mkNP: CN = MassNP $1
mkNP: N = MassNP (UseN $1)
mkNP: Predet NP = PredetNP $1 $2
mkNP: NP V2 = PPartNP $1 $2
mkNP: NP Adv = AdvNP $1 $2
mkNP: NP RS = RelNP $1 $2
mkNP: Conj NP NP = ConjNP $1 (BaseNP $2 $3)
mkNP: Conj ListNP = ConjNP $1 $2
mkNP': Predet NP = $2 | PredetNP $1 $2
mkNP': NP Adv = $1 | AdvNP $1 $2
mkNP': NP RS = $1 | RelNP $1 $2
mkDet: Quant Ord = DetQuantOrd $1 NumSg $2
mkDet: Quant Num Ord = DetQuantOrd $1 $2 $3
mkDet: Quant Card = DetQuant $1 (NumCard $2)
mkQuant: Pron = PossPron $1
mkNum: AdN Card = NumCard (AdNum $1 $2)
mkNum: Digit = NumCard (NumNumeral (num (pot2as3 (pot1as2 (pot0as1 (pot0 $1))))))
mkCard: AdN Card = AdNum $1 $2
mkOrd: Numeral = OrdNumeral $1
mkOrd: Digits = OrdDigits $1
mkOrd: Digit = OrdNumeral (num (pot2as3 (pot1as2 (pot0as1 (pot0 $1)))))
mkOrd: A = OrdSuperl $1
mkAdN: CAdv = AdnCAdv $1
mkNumeral: Sub10 = num (pot2as3 (pot1as2 (pot0as1 $1)))
mkNumeral: Sub100 = num (pot2as3 (pot1as2 $1))
mkNumeral: Sub1000 = num (pot2as3 $1)
mkNumeral: Sub1000 Sub1000 = num (pot3plus $1 $2)
thousandfoldNumeral: Sub1000 = num (pot3 $1)
mkSub1000: Sub100 = pot1as2 $1
mkSub1000: Sub10 = pot2 $1
mkSub1000: Sub10 Sub100 = pot2plus $1 $2
mkSub100: Sub10 = pot0as1 $1
mkSub100: Sub10 Sub10 = pot1plus $1 $2
tenfoldSub100: Sub10 = pot1 $1
mkDigits: Dig = IDig $1
mkDigits: Dig Digits = IIDig $1 $2
mkCN: N = UseN $1
mkCN: N2 NP = ComplN2 $1 $2
mkCN: N3 NP NP = ComplN2 (ComplN3 $1 $2) $3
mkCN: N2 = UseN2 $1
mkCN: N3 = UseN2 (Use2N3 $1)
mkCN: Conj ListCN = ConjCN $1 $2
mkAP: A = PositA $1
mkAP: A NP = ComparA $1 $2
mkAP: A2 NP = ComplA2 $1 $2
mkAP: A2 = UseA2 $1
mkAP: V2 = PastPartAP (SlashV2a $1)
mkAP: VPSlash = PastPartAP $1
mkAP: V = PresPartAP (UseV $1)
mkAP: VP = PresPartAP $1
mkAP: Conj AP AP = ConjAP $1 (BaseAP $2 $3)
mkAP: Conj ListAP = ConjAP $1 $2
mkAP: CAdv AP NP = CAdvAP $1 $2 $3
mkAP': VPSlash NP = PastPartAP $1 | PastPartAgentAP $1 $2
reflAP: A2 = ReflA2 $1 ReflPron
comparAP: A = UseComparA $1
mkAdv: A = PositAdvAdj $1
mkAdv: Prep NP = PrepNP $1 $2
mkAdv: Subj S = SubjS $1 $2
mkAdv: CAdv A NP = ComparAdvAdj $1 $2 $3
mkAdv: CAdv A S = ComparAdvAdjS $1 $2 $3
mkAdv: AdA Adv = AdAdv $1 $2
mkAdv: Conj Adv Adv = ConjAdv $1 (BaseAdv $2 $3)
mkAdv: Conj ListAdv = ConjAdv $1 $2
mkAdv: LN = InLN $1
mkQS: Temp Pol QCl = UseQCl $1 $2 $3
mkQS: Cl = TUseQCl TPres ASimul PPos (QuestCl $1)
mkQCl: Cl = QuestCl $1
mkQCl: IP NP V2 = QuestSlash $1 (SlashVP $2 (SlashV2a $3))
mkQCl: IP ClSlash = QuestSlash $1 $2
mkQCl: IAdv Cl = QuestIAdv $1 $2
mkQCl: Prep IP Cl = QuestIAdv (PrepIP $1 $2) $3
mkQCl: IAdv NP = QuestIComp (CompIAdv $1) $2
mkQCl: IComp NP = QuestIComp $1 $2
mkQCl: IP = ExistIP $1
mkIComp: IAdv = CompIAdv $1
mkIComp: IP = CompIP $1
mkIP: IDet CN = IdetCN $1 $2
mkIP: IDet N = IdetCN $1 (UseN $2)
mkIP: IDet = IdetIP $1
mkIP: IQuant CN = IdetCN (IdetQuant $1 NumSg) $2
mkIP: IQuant Num CN = IdetCN (IdetQuant $1 $2) $3
mkIP: IQuant N = IdetCN (IdetQuant $1 NumSg) (UseN $2)
mkIP: IP Adv = AdvIP $1 $2
mkIAdv: Prep IP = PrepIP $1 $2
mkIAdv: IAdv Adv = AdvIAdv $1 $2
mkIDet: IQuant Num = IdetQuant $1 $2
mkIDet: IQuant = IdetQuant $1 NumSg
mkRS: Conj RS RS = ConjRS $1 (BaseRS $2 $3)
mkRS: Conj ListRS = ConjRS $1 $2
mkRCl: RP NP V2 = RelSlash $1 (SlashVP $2 (SlashV2a $3))
mkRCl: RP ClSlash = RelSlash $1 $2
mkRCl: Cl = RelCl $1
mkRP: Prep NP RP = FunRP $1 $2 $3
mkSSlash: Temp Pol ClSlash SSlash = UseSlash $1 $2 $3
mkClSlash: NP VPSlash = SlashVP $1 $2
mkClSlash: NP V2 = SlashVP $1 (SlashV2a $2)
mkClSlash: NP VV V2 = SlashVP $1 (SlashVV $2 (SlashV2a $3))
mkClSlash: Cl Prep = SlashPrep $1 $2
mkClSlash: ClSlash Adv = AdvSlash $1 $2
mkClSlash: NP VS SSlash = SlashVS $1 $2 $3
mkVPSlash: V2 = SlashV2a $1
mkVPSlash: V3 NP = Slash2V3 $1 $2
mkVPSlash: V2A AP = SlashV2A $1 $2
mkVPSlash: V2Q QS = SlashV2Q $1 $2
mkVPSlash: V2S S = SlashV2S $1 $2
mkVPSlash: V2V VP = SlashV2V $1 $2
mkVPSlash: VV VPSlash = SlashVV $1 $2
mkVPSlash: V2V NP VPSlash = SlashV2VNP $1 $2 $3
mkVPSlash: VPSlash Adv = AdvVPSlash $1 $2
mkVPSlash': VPSlash Adv = $1 | AdvVPSlash $1 $2
mkUttImpSg: Pol Imp = UttImpSg $1 $2
mkUttImpPl: Pol Imp = UttImpPl $1 $2
mkUttImpPol: Pol Imp = UttImpPol $1 $2
"""


def _arg(t: str) -> str:
    return f"({t})" if " " in t else t


def _shift(t: str, by: int) -> str:
    for i in range(9, 0, -1):
        t = t.replace(f"${i}", f"${i + by}")
    return t


def by_rule() -> list[str]:
    """Overloads that follow from others: predicates behind subjects, tense and polarity, determiners, nouns with modifiers."""
    pred = ["V = UseV $1", "V3 NP NP = ComplSlash (Slash3V3 $1 $3) $2", "VV VP = ComplVV $1 ASimul PPos $2", "VS S = ComplVS $1 $2", "VQ QS = ComplVQ $1 $2", "VA AP = ComplVA $1 $2", "V2A NP AP = ComplV2A $1 $2 $3"]
    pred += [f"V2{x} NP {c} = ComplSlash (SlashV2{x} $1 $3) $2" for x, c in (("S", "S"), ("Q", "QS"), ("V", "VP"))]
    pred += [f"{s} = UseComp {_arg(c)}" for s, c in (("A", "CompAP (PositA $1)"), ("A NP", "CompAP (ComparA $1 $2)"), ("A2 NP", "CompAP (ComplA2 $1 $2)"), ("AP", "CompAP $1"), ("NP", "CompNP $1"), ("N", "CompCN (UseN $1)"), ("CN", "CompCN $1"), ("Adv", "CompAdv $1"))]
    slash = "VPSlash NP = ComplSlash $1 $2"
    clause = [*pred, "V2 NP = ComplV2 $1 $2", "VA A = ComplVA $1 (PositA $2)", "V2A NP A = ComplV2A $1 $2 (PositA $3)", "VP = $1"]
    out = [f"mkVP: {p}" for p in [*pred, slash]]
    for name, subject, fun in (("mkCl", "NP", "PredVP"), ("mkQCl", "IP", "QuestVP"), ("mkRCl", "RP", "RelVP")):
        for p in [*clause, slash] if name == "mkCl" else clause:
            sig, t = p.split(" = ")
            out.append(f"{name}: {subject} {sig} = {fun} $1 {_arg(_shift(t, 1))}")
    # any of tense, anteriority and polarity may be left out
    for name, cat, fun in (("mkS", "Cl", "UseCl"), ("mkRS", "RCl", "UseRCl"), ("mkVPS", "VP", "MkVPS"), ("mkQS", "QCl", "TUseQCl")):
        for k in range(8):
            own = [c for i, c in enumerate(("Tense", "Ant", "Pol")) if k >> i & 1]
            tense, ant, pol = (f"${own.index(c) + 1}" if c in own else d for c, d in (("Tense", "TPres"), ("Ant", "ASimul"), ("Pol", "PPos")))
            temp = f"{tense} {ant}" if name == "mkQS" else f"(TTAnt {tense} {ant})"
            out.append(f"{name}: {' '.join([*own, cat])} = {fun} {temp} {pol} ${len(own) + 1}")
        if name != "mkQS":
            out.append(f"{name}: Temp Pol {cat} = {fun} $1 $2 $3")
    # numbers as cardinals, numbers and determiners
    cards = {"Numeral": "NumNumeral $1", "Digits": "NumDecimal (PosDecimal $1)", "Decimal": "NumDecimal $1", "Card": "$1"}
    for cat, t in cards.items():
        if cat in ("Numeral", "Digits"):
            out.append(f"mkCard: {cat} = {t}")
        out.append(f"mkNum: {cat} = NumCard {_arg(t)}")
        out.append(f"mkDet: {cat} = DetQuant IndefArt (NumCard {_arg(t)})")
    out += ["mkDet: Quant = DetQuant $1 NumSg", "mkDet: Quant Num = DetQuant $1 $2", "mkDet: Pron = DetQuant (PossPron $1) NumSg", "mkDet: Pron Num = DetQuant (PossPron $1) $2"]
    dets = {"Quant": "DetQuant $1 NumSg", "Quant Num": "DetQuant $1 $2", "Det": "$1", "Num": "DetQuant IndefArt $1", "Pron": "DetQuant (PossPron $1) NumSg"} | {c: f"DetQuant IndefArt (NumCard {_arg(t)})" for c, t in cards.items()}
    for sig, t in dets.items():
        n = len(sig.split()) + 1
        out += [f"mkNP: {sig} CN = DetCN {_arg(t)} ${n}", f"mkNP: {sig} N = DetCN {_arg(t)} (UseN ${n})"]
    # nouns and adjectives with what modifies them; the primed forms leave the modifier out by default
    mods = [("A N", "AdjCN (PositA $1) (UseN $2)"), ("A CN", "AdjCN (PositA $1) $2"), ("AP N", "AdjCN $1 (UseN $2)"), ("AP CN", "AdjCN $1 $2"), ("N RS", "RelCN (UseN $1) $2"), ("CN RS", "RelCN $1 $2"), ("N Adv", "AdvCN (UseN $1) $2"), ("CN Adv", "AdvCN $1 $2")]
    out += [f"mkCN: {s} = {t}" for s, t in mods] + [f"mkCN': {s} = {'UseN ' if 'N' in s.split() else ''}${1 if s.split()[0] in ('N', 'CN') else 2} | {t}" for s, t in mods if s != "A N"]
    out += ["mkCN: CN AP = AdjCN $2 $1", "mkCN: N AP = AdjCN $2 (UseN $1)", "mkCN: N NP = ApposCN (UseN $1) $2", "mkCN: CN NP = ApposCN $1 $2"]
    for cat in ("CN", "AP"):
        for c, t in (("S", "(EmbedS $2)"), ("QS", "(EmbedQS $2)"), ("VP", "(EmbedVP ASimul PPos it_Pron $2)"), ("SC", "$2")):
            out += [f"mk{cat}: {cat} {c} = Sent{cat} $1 {t}", f"mk{cat}': {cat} {c} = $1 | Sent{cat} $1 {t}"]
    for c, t in (("A", "(PositA $2)"), ("AP", "$2")):
        out += [f"mkAP: AdA {c} = AdAP $1 {t}", f"mkAP': AdA {c} = {t.strip('()')} | AdAP $1 {t}"]
    return out


def overloads() -> list[tuple[str, str, str]]:
    """(constructor, categories, trees)."""
    out = []
    for line in [*TREES.strip().split("\n"), *by_rule()]:
        head, t = line.split(" = ", 1)
        name, sig = head.split(": ")
        out.append((name, sig, t))
    return out


def _built(spark, rows):
    @F.pandas_udf("string")
    def trees(name: pd.Series, sig: pd.Series) -> pd.Series:
        one = lambda n, s: " | ".join(constructors.alternatives(n, *((c, f"x{i}") for i, c in enumerate(s.split(), 1))))
        return pd.Series([one(n, s) for n, s in zip(name, sig, strict=True)])

    df = spark.createDataFrame(rows, "name string, sig string")
    return df.select("name", "sig", trees("name", "sig").alias("tree"))


def constructor_overloads(spark, d):
    return _built(spark, [(n, s) for n, s, _ in overloads()])


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
QUERIES["constructor_overloads"] = constructor_overloads
ORACLES["constructor_overloads"] = "SELECT name, sig, replace(tree, '$', 'x') AS tree FROM (VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in overloads()) + ") t(name, sig, tree)"


def constructor_numbers(spark, d):
    """Constructors of number literals over the order keys: digits, decimals, numerals and cardinals."""
    from lexloom.session import table

    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).distinct()

    cols = [("digits", "mkDigits", lambda x: x), ("dec", "mkDecimal", lambda x: -x), ("num", "mkNum", lambda x: x), ("card", "mkCard", lambda x: 999_999 + x)]

    @F.pandas_udf("struct<digits:string,dec:string,num:string,card:string>")
    def built(n: pd.Series) -> pd.DataFrame:
        make = lambda c, x: constructors.construct(c, ("int", str(x)))
        return pd.DataFrame({c: [make(f, k(x)) for x in n] for c, f, k in cols})

    return n.select("n", built("n").alias("t")).select("n", "t.digits", "t.dec", "t.num", "t.card")


QUERIES["constructor_numbers"] = constructor_numbers
ORACLES["constructor_numbers"] = """
WITH n AS (SELECT DISTINCT o_orderkey AS n FROM orders),
t AS (SELECT n, list_reduce(list_prepend('IDig D_' || right(n::VARCHAR, 1), list_reverse(string_split(left(n::VARCHAR, -1), ''))), lambda a, x: CASE WHEN x = '' THEN a ELSE 'IIDig D_' || x || ' (' || a || ')' END) AS digits FROM n)
SELECT n, digits, CASE WHEN n = 0 THEN 'PosDecimal (' ELSE 'NegDecimal (' END || digits || ')' AS dec, 'NumCard (NumDecimal (PosDecimal (' || digits || ')))' AS num, 'NumDecimal (PosDecimal (' || (SELECT list_reduce(list_prepend('IDig D_' || right(m::VARCHAR, 1), list_reverse(string_split(left(m::VARCHAR, -1), ''))), lambda a, x: CASE WHEN x = '' THEN a ELSE 'IIDig D_' || x || ' (' || a || ')' END) FROM (SELECT n + 999999 AS m)) || '))' AS card FROM t"""


def conjunct_lists(spark, d):
    """Each order's lines as a list of conjuncts, first to last, in the categories that have lists."""
    from lexloom.session import table

    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), "l_partkey"))).alias("items")).filter(F.size("items") > 1)

    cats = ("S", "Adv", "AP", "NP", "RS")

    @F.pandas_udf("array<string>")
    def listed(items: pd.Series) -> pd.Series:
        return pd.Series([constructors.make_lists(cats, *x) for x in items])

    trees_ = li.select(F.col("l_orderkey").alias("id"), F.arrays_zip(F.array(*map(F.lit, cats)).alias("cat"), listed("items").alias("tree")).alias("x"))
    return trees_.select("id", F.explode_outer("x").alias("x")).select("id", "x.cat", "x.tree")


QUERIES["conjunct_lists"] = conjunct_lists
ORACLES["conjunct_lists"] = """
WITH i AS (SELECT l_orderkey AS id, list_reverse(list_sort(list_distinct(list('p' || l_partkey)))) AS x FROM lineitem GROUP BY 1),
c(cat) AS (VALUES ('S'), ('Adv'), ('AP'), ('NP'), ('RS'))
SELECT id, cat, list_reduce(list_prepend('Base' || cat || ' ' || x[2] || ' ' || x[1], x[3:]), lambda a, y: 'Cons' || cat || ' ' || y || ' (' || a || ')') AS tree FROM i, c WHERE len(x) > 1"""


def constructor_dispatch(spark, d):
    """Overloads chosen by what the arguments are: names, verbs with and without object, and numbers."""
    from lexloom.session import table

    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("kind")).distinct()

    @F.pandas_udf("string")
    def built(p: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        def one(a, b, kind):
            cats = {f"p{a}_PN": "PN", f"s{b}_NP": "NP", "sleep_V": "V", "see_V2": "V2"}
            if kind == 0:
                return constructors.dispatched("mkCl", f"s{b}_NP", "sleep_V", cats=cats)
            if kind == 1:
                return constructors.dispatched("mkCl", f"s{b}_NP", "see_V2", f"s{b}_NP", cats=cats)
            return constructors.dispatched("mkDigits", int(b), cats=cats)

        return pd.Series([one(*r) for r in zip(p, s, k, strict=True)])

    return li.select("l_partkey", "l_suppkey", "kind", built("l_partkey", "l_suppkey", "kind").alias("tree"))


QUERIES["constructor_dispatch"] = constructor_dispatch
ORACLES["constructor_dispatch"] = """
SELECT l_partkey, l_suppkey, kind, CASE kind WHEN 0 THEN 'PredVP s' || l_suppkey || '_NP (UseV sleep_V)' WHEN 1 THEN 'PredVP s' || l_suppkey || '_NP (ComplV2 see_V2 s' || l_suppkey || '_NP)'
  ELSE list_reduce(list_prepend('IDig D_' || right(l_suppkey::VARCHAR, 1), list_reverse(string_split(left(l_suppkey::VARCHAR, -1), ''))), lambda a, x: CASE WHEN x = '' THEN a ELSE 'IIDig D_' || x || ' (' || a || ')' END) END AS tree
FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber % 3 AS kind FROM lineitem)"""
