"""Code sets: which codes, tests or drugs make up a concept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.text import match_patterns, none_of, without_dots


@dataclass(frozen=True)
class NameRule:
    """Names of one concept: wildcard lists, names that always or never count, and
    concepts whose names are taken out again."""

    concept: str
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    exact: Sequence[str] = ()
    not_exact: Sequence[str] = ()
    minus: Sequence[str] = ()

    def test(self, text: str | Column) -> Column:
        return F.coalesce(match_patterns(text, self.include, self.exclude, self.exact, self.not_exact),
                          F.lit(False))


def code_set(dim: DataFrame, text: str, rules: Sequence[NameRule], keep: Sequence[str] = (),
             concept: str = "concept") -> DataFrame:
    """(concept, keep..., text) for every rule a row of the dimension satisfies, in one scan."""
    by_name = {r.concept: r for r in rules}
    hits = []
    for rule in rules:
        test = rule.test(text)
        for other in rule.minus:
            test = test & ~by_name[other].test(text)
        hits.append(F.when(test, F.lit(rule.concept)))
    matched = dim.select(*dict.fromkeys([*keep, text]), F.explode(F.array_compact(F.array(*hits))).alias(concept))
    return matched.select(concept, *dict.fromkeys([*keep, text])).distinct()


def stack_code_sets(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of code sets without duplicates."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def listed_codes(master: DataFrame, concepts: Sequence[str], concept: str = "concept") -> DataFrame:
    """Rows of a curated code table for the listed concepts."""
    return master.where(F.col(concept).isin(list(concepts)))


def listed_shots(shots: DataFrame, code: str, at: str, first: str, last: str,
                 wanted: Sequence[str] | None = None) -> DataFrame:
    """Immunisations whose code is listed (influenza by default), from day ``first`` to midnight of ``last``."""
    listed = INFLUENZA_VACCINES if wanted is None else list(wanted)
    return shots.where(F.trim(F.col(code).cast("string")).isin(listed)
                       & F.col(at).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))


def numbered_codes(master: DataFrame, groups: Mapping[int, str], number: str, concept: str = "concept",
                   otherwise: str = "OTHER") -> DataFrame:
    """Rows of a numbered code table, with the concept that each number stands for."""
    label = reduce(lambda acc, g: acc.when(F.col(number) == g[0], g[1]), list(groups.items())[1:],
                   F.when(F.col(number) == list(groups)[0], list(groups.values())[0])).otherwise(otherwise)
    return master.where(F.col(number).isin(list(groups))).withColumn(concept, label)


def pattern_codes(dim: DataFrame, code: str, rules: Sequence[NameRule], vocabulary: int) -> DataFrame:
    """(concept, code, code_no_dot, vocabulary) from wildcard rules on a code dimension."""
    return code_set(dim, code, rules).select(
        "concept", F.col(code).alias("code"), without_dots(code).alias("code_no_dot"),
        F.lit(vocabulary).alias("vocabulary"))


def resolve_codes(dim: DataFrame, codes: DataFrame, dim_code: str, keep: Sequence[str],
                  vocabulary: int | None = None) -> DataFrame:
    """(keep..., code, concept) of dimension rows whose code is in the set."""
    wanted = codes if vocabulary is None else codes.where(F.col("vocabulary") == vocabulary)
    wanted = wanted.select(F.col("code").alias(dim_code), "concept").distinct()
    return dim.join(wanted, dim_code).select(*keep, dim_code, "concept").distinct()


# Heart-failure code patterns by vocabulary.
HEART_FAILURE_9 = NameRule("HF", include=["402._1%", "404._1%", "404._3%", "428%"])
HEART_FAILURE_10 = NameRule("HF", include=["I11.0%", "I13.0%", "I13.2%", "I50%"])

# Comorbidity code patterns by vocabulary.
COMORBIDITY_9 = [
    NameRule("HeartTx", include=["V42.1%"]),
    NameRule("Anemia", include=["28[0-5]%"]),
    NameRule("Dementia", include=["290%", "331.[0-1]%", "331.8[2-3]%"]),
]
COMORBIDITY_10 = [
    NameRule("HeartTx", include=["Z94.1%"]),
    NameRule("Anemia", include=["D5%", "D6[0-4]%"]),
    NameRule("Dementia", include=["F0[0-3]%", "G30%", "G31.0%", "G31.8[3-4]%"]),
]

# Curated comorbidity concepts and numbered groups.
COMORBIDITY_LISTED = [
    "Any_malignancy", "CMB_AFibFlutter", "CMB_ARD", "CMB_Cardiomyopathy", "CMB_CKD", "CMB_COPD", "CMB_DM",
    "CMB_DVT_PE", "CMB_DysLipid", "CMB_HTN", "CMB_MDD", "CMB_OSA", "CMB_PAD", "CMB_SRD", "CMB_VHD", "MI", "Flu",
    "Fracture", "HemoStroke", "IschemicStroke", "SAH", "TIA",
]
COMORBIDITY_NUMBERED = {9901: "LVAD", 9907: "Long_QT", 9910: "Brugada"}

# Drug classes, and names kept out of the potassium-sparing class.
DRUG_CLASSES = ["RX_betaBlocker", "RX_Diuretic_potassium", "RX_Diuretic_TZD", "RX_Diuretics_loop", "RX_GLP1",
                "RX_lipid_statin", "RX_SGLT2"]
DRUG_NAMES_EXCLUDED = ["%AMILORIDE%", "%TRIAMTERENE%"]
DIGOXIN = NameRule("RX_Digoxin", include=["%DIGOXIN%"])
DIGOXIN_FORMS_EXCLUDED = ["INJ,SOLN"]

# Vaccine codes that count as an influenza shot.
INFLUENZA_VACCINES = ["15", "16", "88", "111", "125", "126", "127", "128", "135", "140", "141", "144", "149", "150", "151", "153",
                      "155", "158", "160", "161", "166", "168", "171", "185", "186", "194", "197", "200", "201", "202", "205",
                      "231", "320"]

# Laboratory test names.
LAB_NAME_RULES = [
    NameRule("BNP", include=["%BNP%", "%brain natriuretic peptide%", "%natriu%pept%"],
             exclude=["%ratio%", "%pro%", "%TELOPEPTIDE%"], exact=["CAPPROF-BNP5"]),
    NameRule(
        "potassium", include=["%[^a-z]K[^a-z]%", "%Potas%"],
        exclude=[
            "%micro%", "%bacteri%", "%C%TRACH%", "%Coli%", "%Latex%", "%N.%Men%", "%C%K%M%B%", "%C%P%K%",
            "%Virus%", "%HCV%", "%HGB%", "%Immuno%", "%Vitamin%", "%X%", "%B-cell%", "%calcium%",
            "%chem%ligand%", "%free%K+L%", "%free%Kappa%", "%free%K/L%", "%ratio%free%", "%rogers%free%",
            "%LT%Chain%Chain%", "%Kappa%", "%[0-9]K%", "%channel%", "%neuro%", "%Q%", "%renal%", "%Ur%",
            "%stool%", "%fec%", "%ratio%", "%volt%", "%24H%", "%24 H%", "%IGE%", "%k-cup%", "%K1000 POC%",
            "%K/L%", "%CLOT%", "%K75%", "%K76%", "%K77%", "%PNEUMONIAE%", "%ANION GAP W/O%", "%DIALYS%",
            "%FLUID%", "%K167%", "%K-1000%", "%CK-7%", "%ACT%", "%TEG%", "%CANNABI%", "%TRACHOMATIS%",
            "%U24%", "%VIT.%", "%STEROIDS%", "%BG ANION GAP(K)%", "%CODON 117 K117N%", "%escherichia%",
            "%INTERP%", "%W515L/K%",
        ],
        not_exact=["ZZSodium/Potassium (OLD 10/00)"]),
    NameRule("NT-proBNP", include=["%BNP%", "%terminal%pep%", "%proBNP%", "%pro[- /_]BNP%",
                                   "%pro brain natriuretic peptide%", "%natriu%pept%"],
             exclude=["%ratio%", "%TELOPEPTIDE%"], minus=["BNP"]),
]


def drug_class_set(classes: DataFrame, national: DataFrame, drug_id: str, drug_class: str, name: str,
                   name_with_dose: str, form: str, wanted: Sequence[str] = tuple(DRUG_CLASSES),
                   excluded_names: Sequence[str] = tuple(DRUG_NAMES_EXCLUDED), by_name: NameRule = DIGOXIN,
                   excluded_forms: Sequence[str] = tuple(DIGOXIN_FORMS_EXCLUDED)) -> DataFrame:
    """Drugs of the wanted classes without the excluded names, plus one class found by name.

    ``classes`` carries (drug_id, drug_class, name, name_with_dose, form) and
    ``national`` the same columns but the class.
    """
    listed = classes.where(F.col(drug_class).isin(list(wanted))
                           & none_of(name, excluded_names))
    named = (national.where(by_name.test(name_with_dose) & ~F.col(form).isin(list(excluded_forms)))
             .withColumn(drug_class, F.lit(by_name.concept)))
    cols = [drug_id, drug_class, name, name_with_dose, form]
    return listed.select(*cols).unionByName(named.select(*cols)).distinct()
