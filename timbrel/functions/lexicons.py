"""Word lists. Every function that uses one takes it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    starts: tuple[str, ...]  # a text that begins so continues another
    ends: tuple[str, ...]  # a text that ends so is continued
    payoff: tuple[str, ...]  # words of a conclusion
    context: tuple[str, ...]  # words that lean on what came before


# Arabic continuation, conclusion and context words.
ARABIC = Lexicon(
    starts=(
        "و", "ف", "ثم", "لكن", "لأن", "لان", "إذا", "اذا", "يعني", "ولهذا", "ولذلك",
        "فهذا", "وهذا", "وهذه", "فهذه", "أما", "اما", "بل", "حتى", "كما", "أي", "اي",
    ),
    ends=("و", "ف", "ثم", "لكن", "لأن", "لان", "إذا", "اذا", "يعني", "مثلا", "مثلًا", "مثال", "وهو", "وهي"),
    payoff=(
        "لذلك", "ولهذا", "فلهذا", "فالخلاصة", "الخلاصة", "فالنتيجة", "النتيجة", "فهذا",
        "إذن", "اذن", "لهذا", "فانظر", "فتأمل", "فتامل", "انتبه", "احذر", "فاحذر",
        "أبشر", "وابشر", "رحمة", "مغفرة", "جنة", "النار", "دعاء", "قرآن", "التوبة", "الخشوع",
        "فاستعد", "فتب", "فارجع", "فاصبر", "فتوكل", "فتذكر", "فاسمع",
    ),
    context=("هذا", "هذه", "ذلك", "تلك", "هو", "هي", "هم", "كما", "أيضا", "ايضا", "كذلك", "حينها", "وقتها"),
)

# Arabic stop words, before normalisation.
ARABIC_STOP = (
    "و", "او", "أو", "ثم", "ف", "ب", "ك", "ل", "في", "من", "عن", "على", "الى", "إلى",
    "ان", "إن", "انا", "أَنَا", "ما", "ماذا", "متى", "كيف", "لم", "لن", "لا", "ليس",
    "هو", "هي", "هم", "هن", "هذا", "هذه", "ذلك", "تلك", "هناك", "هنا", "كل", "كما",
    "قد", "كان", "كانت", "يكون", "تكون", "الذي", "التي", "الذين", "اللاتي",
    "يا", "اي", "أي", "اذا", "إذا", "بل", "حتى", "بعد", "قبل", "عند", "بين", "مع",
    "له", "لها", "لهم", "عليه", "عليها", "عليهم", "به", "بها", "بهم", "فيه", "فيها",
    "انه", "إنه", "انها", "إنها", "قال", "قالوا", "قلت", "يقول", "تقول", "رب", "ربي",
    "الله", "اللهم",
)

# Words of a scene that a prompt may name.
SCENES = ("dawn", "night", "rain", "ocean", "desert", "mist", "mosque", "courtyard", "dusk", "dark")

#: For texts in Latin script.
LATIN = Lexicon(
    starts=("and", "or", "but", "that", "und", "oder", "et", "ou", "y", "o", "of the"),
    ends=("the", "of", "and", "to", "der", "die", "de", "la", "el"),
    payoff=("therefore", "thus", "is", "was", "ist", "est", "es"),
    context=("this", "that", "it", "these", "he", "das", "ce", "lo"),
)
