"""The text of the hypothesis report (H7): the statistics are tables of a few rows; this only lays them out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from specmark.functions.domains import MODES
from specmark.operators import entropy as E
from specmark.operators import stats

WIDTH = 70
#: Headings and sentences of the report.
TITLE = "RAPPORT — TEST D'HYPOTHÈSE SUR LA DISPERSION DES MARQUEURS"
HYPOTHESIS = (
    "Hypothèse : les marqueurs des émotions Montree et Suggeree",
    "présentent une plus grande dispersion (entropie plus élevée)",
    "que les marqueurs des émotions Designee et Comportementale.",
)
VERDICTS = {
    "p < 0.001": "TRÈS FORTEMENT supportée (p < 0.001)",
    "p < 0.01": "FORTEMENT supportée (p < 0.01)",
    "p < 0.05": "SUPPORTÉE (p < 0.05)",
    "p >= 0.05": "NON SUPPORTÉE (p >= 0.05)",
}
KRUSKAL = "TEST DE KRUSKAL-WALLIS (4 modes)"
DIFFERENT = "Différence significative entre les modes (p < 0.05)"
ALIKE = "Pas de différence significative entre les modes (p >= 0.05)"
MANN_WHITNEY = "TEST DE MANN-WHITNEY U (Montree+Suggeree vs Designee+Comportementale)"
ONE_SIDED = "  Hypothèse H1 : entropie(Montree+Suggeree) > entropie(Designee+Comportementale)"
PAIRS = "COMPARAISONS PAR PAIRES (Mann-Whitney U, bilatéral)"
DESCRIBED = "STATISTIQUES DESCRIPTIVES PAR MODE"
NO_MARKER, NO_DATA = "aucun marqueur", "Aucune donnée d'entropie disponible."
END = "FIN DU RAPPORT"
ONE_SIDED_LINES = (
    "  U = {u:.4f}, p (unilatéral) = {p}",
    "  Moyenne Montree+Suggeree     : {mean_high:.4f} (n={n1})",
    "  Moyenne Designee+Comportementale : {mean_low:.4f} (n={n2})",
    "  Différence de moyennes       : {difference:.4f}",
    "  Taille d'effet (r)           : {r:.4f}",
    "  → Hypothèse : {verdict}",
)
#: Where all entropies tie, no test says anything.
UNDEFINED = "non défini (toutes les entropies sont égales)"


def _number(x: float | None, places: int) -> str:
    return "non défini" if x is None else f"{x:.{places}f}"


def _section(title: str, body: list[str], rule: str = "-") -> list[str]:
    return [rule * WIDTH, title, rule * WIDTH, *body]


def hypothesis_report(of_modes: DataFrame, modes: Sequence[str] = MODES) -> str:
    spectrum = E.spectrum(of_modes, modes).persist()
    try:
        summary = E.summary_of(spectrum, modes, population=True).collect()
        kruskal = stats.kruskal_wallis_of(spectrum, modes).collect()
        high_low = stats.mann_whitney_of(spectrum, modes, high=(modes[2], modes[3]), low=(modes[1], modes[0])).collect()
        pairs = stats.mann_whitney_pairs_of(spectrum, modes).collect()
    finally:
        spectrum.unpersist()
    if not any(s.n_markers for s in summary):
        return NO_DATA
    described = [
        f"  {s.mode:20s} : n={s.n_markers:5d}, moy={s.mean_entropy:.4f}, méd={s.median_entropy:.4f}, σ={_number(s.std_entropy, 4)}"
        if s.n_markers
        else f"  {s.mode:20s} : {NO_MARKER}"
        for s in summary
    ]
    lines = _section(TITLE, ["", *HYPOTHESIS, ""], "=") + _section(DESCRIBED, [*described, ""])
    for k in kruskal:
        lines += _section(KRUSKAL, [f"  H = {_number(k.h, 4)}, p = {_number(k.p, 6)}", f"  → {UNDEFINED if k.p is None else DIFFERENT if k.p < 0.05 else ALIKE}", ""])
    for m in high_low:
        shown = m.asDict() | {"p": _number(m.p, 6), "verdict": VERDICTS.get(m.verdict, UNDEFINED)}
        lines += _section(MANN_WHITNEY, [ONE_SIDED, *(line.format(**shown) for line in ONE_SIDED_LINES), ""])
    compared = [f"  {x.mode1} vs {x.mode2} : U={x.u:.1f}, p={_number(x.p, 6)} [{x.stars or '-'}]" for x in pairs]
    lines += _section(PAIRS, [*compared, ""])
    return "\n".join(lines + _section(END, [], "="))
