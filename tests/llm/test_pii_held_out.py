"""Recall of the tagger on contexts and values that share no sentence with its training lines or the test tables."""

import random
import re

import numpy as np
import pytest

from tarnfold.llm import bilstm, pii, pii_training

CONTEXTS = """The raffle prize goes to {N} this year.|Has anyone seen {N} since lunch?|{N} repaired the kiln at the weekend.|The piano tuner, {N}, charges by the hour.|We named the boat after {N}.|Notes from a walk with {N} along the dyke.|Grandmother's friend {N} baked the cake.|The harbour office asked {N} to move the barge.|It was {N} who found the wallet.|The role of the judge was played by {N}.|Committee: {N}, {N} and {N}.|landlord = "{N}"|# idea from {N}|"chair": "{N}"|{N} won't be at choir practice.|{N} from the library rang back.|Der Schreiner {N} bringt den Tisch.|Unsere Nachbarin {N} hat Eier übrig.|Le voisin {N} tond la pelouse.|La prima {N} toca el violín.|Il postino si chiama {N}.|O padeiro {N} abre cedo.|De bakker {N} is gesloten.|Sąsiadka {N} podlewa kwiaty.|Grannen {N} lånade stegen.|
Pictures should reach {E} by noon.|The waiting list is kept by {E} now.|"mailbox": "{E}"|Anmeldung über {E} bis Freitag.|Les inscriptions passent par {E}.|Las fotos van a {E} hoy.|ticket opened from {E}|# bounce: {E}|
The boiler man is on {P} today.|Leave a message at {P} after the tone.|"cell": "{P}"|Der Notdienst hat die {P}.|Le gardien répond au {P} le soir.|El taller contesta en {P}.|# modem dials {P}|beeper {P} did not answer|
The choir rehearses at {A} every Monday evening.|The removal van stands before {A} already.|"depot": "{A}"|Das Paket liegt in {A} beim Pförtner.|La livraison se fait au {A} avant midi.|# warehouse: {A}|
The guard copied {I} into the book.|Her papers show {I} and nothing else.|"document": "{I}"|Am Schalter wollte man {I} sehen.|Le guichet a demandé {I}.|# typed in: {I}""".replace("|\n", "|").split("|")
NAMES = ["Jonathan Whitfield", "Marguerite Delacroix", "SCHMIDT, Anna", "Okonkwo, Daniel", "T. Haverkamp", "Ingeborg Thalberg", "Rafael Quintana", "Beatrix Ostrowska", "Halvard Nyström", "Ottilie Brandauer", "Desmond Achterberg", "Wilhelmina Post", "Leopold von Ahrens", "Giancarlo Benvenuti", "PHILIPPA LANGDON", "Kasimir Wolański"]
PLACES = ["14 Birchwood Crescent, Leeds LS6 2AB", "7 Harbour Lane, Whitby YO2 4DJ", "Lindenstraße 48, 04177 Leipzig", "12 rue des Tanneurs, 67000 Strasbourg", "Calle Mayor 23, 28013 Madrid", "Via Garibaldi 9, 10122 Torino", "ul. Długa 31, 31-147 Kraków", "Storgatan 16, 411 38 Göteborg", "Keizersgracht 210, 1016 DX Amsterdam", "Rua das Flores 77, 4050-262 Porto"]


def draw(r, context):
    text, spans, rest = "", [], context
    while m := re.search(r"\{(.)\}", rest):
        text += rest[: m.start()]
        kind = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}[m[1]]
        if kind == "id_number":
            label, value = pii_training.number()
            text += label
        else:
            value = {"name": lambda: r.choice(NAMES), "email": lambda: pii_training.email(["Jonathan", "Beatrix", "Rafael"], ["Langdon", "Quintana"]), "phone": pii_training.phone, "address": lambda: r.choice(PLACES)}[kind]()
        spans.append((len(text), len(text) + len(value), kind))
        text, rest = text + value, rest[m.end() :]
    return text + rest, spans


def score(tagger, draws=12):
    r = random.Random(5)
    pii_training._R.seed(5)
    lines = [draw(r, c) for c in CONTEXTS for _ in range(draws)]
    found, hit, total, extra = tagger.tag([t for t, _ in lines]), {}, {}, 0
    for (_, spans), got in zip(lines, found):
        for a, b, kind in spans:
            total[kind] = total.get(kind, 0) + 1
            hit[kind] = hit.get(kind, 0) + any(k == kind and min(b, e) - max(a, s) >= 0.8 * (b - a) for s, e, k in got)
        extra += sum(not any(k == kind and s < b and a < e for a, b, kind in spans) for s, e, k in got)
    return {k: round(hit[k] / total[k], 3) for k in sorted(total)}, round(extra / max(1, sum(map(len, found))), 3)


def test_held_out_recall():
    ours = {p for c in CONTEXTS for p in re.split(r"\{.\}", c) if len(p.strip()) >= 12}
    theirs = "\n".join(pii_training.CONTEXTS + pii_training.OTHERS)
    assert not [p for p in ours if p in theirs]
    recall, extra = score(pii.Tagger(["Anna", "Daniel"], ["Schmidt"]))
    print("held-out recall", recall, "share of spans beside the true ones", extra)
    assert all(v >= 0.85 for k, v in recall.items() if k != "name") and recall["name"] >= 0.6 and extra < 0.05


@pytest.mark.parametrize("line", ["flow of 10 m³ today, order 4711-22", "git@code.lantern.example:tools/box.git", "Monday Morning Market opens at nine", "sha1: 2fd4e1c67a2d28fced849ee1bb76e7391b93eb12", ""])
def test_no_mention(line):
    assert pii.Tagger([], []).tag([line, None]) == [[], []]


def test_network_reads_every_character(monkeypatch):
    """Text without a capital, digit or sign is read as all else is, once where texts are equal, and windows leave no gap."""
    tagger, seen = pii.Tagger([], []), []
    read = tagger.network.read
    monkeypatch.setattr(tagger.network, "read", lambda codes: seen.extend(map(len, codes)) or read(codes))
    plain = "the lamp by the door was left on all night "
    tagger.tag([plain, None, "", plain, plain[:7]])
    assert sorted(seen) == [7, len(plain)]
    for n in (1, pii.WINDOW, pii.WINDOW + 1, 5 * pii.WINDOW + 17):
        starts = pii.windows(n, 0, n)
        assert {k for s in starts for k in range(s, min(n, s + pii.WINDOW))} == set(range(n))


@pytest.mark.parametrize("name", ["lanomar kobelski", "tilmar bodinski"])
def test_lower_case_name_of_unknown_parts(name):
    """No part is in the table and nothing has a capital."""
    line = f"signed by {name}"
    assert [(line[a:b], k) for a, b, k in pii.Tagger([], []).tag([line])[0] if k == "name"] == [(name, "name")]


def test_sequences_of_any_length_as_plainly():
    """Whole sequences of many lengths, decoded between sure places, against plain scores and Viterbi of each."""
    p, r = pii.weights(), np.random.RandomState(3)
    chars = [r.randint(0, pii.number_of_classes(), n) for n in (0, 1, 2, 33, 95, 96, 300, 300)]
    given = [(r.rand(len(c), pii.FEATURES) > 0.7).astype(np.uint8) for c in chars]
    found = bilstm.Network(p).read([(c << pii.FEATURES) + g @ np.array([1, 2, 4]) for c, g in zip(chars, given)])
    for c, g, label in zip(chars, given, found):
        want = bilstm.viterbi(bilstm.scores(p, c[:, None], g[:, None]), p["t"])[:, 0] if len(c) else np.zeros(0, np.int8)
        assert (label is None and not want.any()) or np.array_equal(label, want)


def test_only_places_that_may_have_a_label_are_decoded():
    """A bound on what a run of labels gains leaves out nothing that is labelled, and most of all else (before, 0.1 % of a text)."""
    p, r = pii.weights(), np.random.RandomState(4)
    network, share = bilstm.Network(p), []
    plain = "The lamp by the door was left on all night, and nobody has read the second chapter of the report on the old bridge. "
    for chars in [r.randint(0, pii.number_of_classes(), n) for n in (1, 2, 40, 300)] + [pii.classes_of(t) for t in (plain * 5, plain + "Write to Anna Schmidt, anna.schmidt@mail.example, or call +49 30 1234567. " + plain, "Anna Schmidt", "call 0171 2345678")]:
        codes = chars.astype(np.int16) << pii.FEATURES
        unsure = network.unsure(*network._read([codes]))[0]
        want = bilstm.viterbi(bilstm.scores(p, chars[:, None], np.zeros((len(chars), 1, pii.FEATURES), np.uint8)), p["t"])[:, 0]
        assert not (want[~unsure] > 0).any()
        share.append(unsure.mean())
    print("share of places decoded", [round(float(s), 3) for s in share])
    assert share[4] < 0.2


def test_long_text_is_read_once_but_for_the_overlaps():
    for n in (pii.WINDOW + 1, pii.WINDOW + 76, 5 * pii.WINDOW + 17, 40_000):
        starts = pii.windows(n, 0, n)
        assert sum(min(pii.WINDOW, n - s) for s in starts) == n + (len(starts) - 1) * (pii.WINDOW - pii.STRIDE)


@pytest.mark.parametrize("text", ["Call ANNA now", "call anna2", "Joanna", "É. élodie", "ÉLODIE\xa0x", "ŁUKASZ i ty", "Łukasz", "Karl", "karl", "Karl”", "\xaaanna", "nothing here", "安anna", "安 Anna"])
def test_parts_of_the_table_are_seen_as_by_the_tokens(text):
    lexicon = pii.Lexicon(["Anna", "Élodie", "Łukasz"], ["Karl"])
    want = any(w.lower() in lexicon.kind for w in pii._TOKEN.findall(text))
    assert lexicon.occurs(text) == want == bool(lexicon.flags(text).any())
