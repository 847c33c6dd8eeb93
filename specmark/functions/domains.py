"""Fixed values of the annotation scheme: they must equal those that the annotated data use."""

EMOTIONS = ("Colere", "Degout", "Joie", "Peur", "Surprise", "Tristesse", "Admiration", "Culpabilite", "Embarras", "Fierte", "Jalousie")
MODES = ("Comportementale", "Designee", "Montree", "Suggeree")
HIGH_MODES, LOW_MODES = ("Montree", "Suggeree"), ("Designee", "Comportementale")

#: One-hot columns of the tabular format and the class that each stands for.
EMOTION_COLUMNS = {
    "Colère": "Colere", "Dégoût": "Degout", "Joie": "Joie", "Peur": "Peur", "Surprise": "Surprise", "Tristesse": "Tristesse",
    "Admiration": "Admiration", "Culpabilité": "Culpabilite", "Embarras": "Embarras", "Fierté": "Fierte", "Jalousie": "Jalousie", "Autre": "Autre",
}
MODE_COLUMNS = {"Comportementale": "Comportementale", "Désignée": "Designee", "Montrée": "Montree", "Suggérée": "Suggeree"}
META_COLUMNS = ("Base", "Complexe")
REQUIRED_COLUMNS = ("idx", "ID", "NAME", "TEXT")
ACTIVE_COLUMN = "Emo"
LINGUISTIC_COLUMNS = ("elongation", "ironie", "insulte", "mépris / haine", "argot", "abréviation", "interjection")
CONTEXT_COLUMNS = ("ROLE", "HATE", "TARGET", "VERBAL_ABUSE", "INTENTION", "CONTEXT", "SENTIMENT")

UNIT_TYPES = ("SitEmo", "Autre")
OTHER = "Autre"

#: Labels of the dashboard, by what annotators write in lower case; null where they say that there is none.
DASHBOARD_LABELS = {name.lower(): name for name in EMOTION_COLUMNS} | {plain.lower(): name for name, plain in EMOTION_COLUMNS.items()}
DASHBOARD_NONE = ("aucun", "aucune", "")

#: French function words, lower case.
STOPWORDS = tuple(
    dict.fromkeys(
        """
le la les l un une des du de d au aux ce cet cette ces mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs
je tu il elle on nous vous ils elles me te se lui y en eux moi toi
qui que quoi dont où lequel auquel duquel laquelle lesquels lesquelles ceci cela ça celui celle ceux celles
à pour sur dans avec par vers sous sans chez entre depuis et ou ni mais or car donc qu quand comme si lorsque puisque quoique
ne pas plus moins très trop aussi bien mal alors ainsi toujours jamais ici là oui non tout tous toute toutes rien personne
aucun autre autres même quelque quelques
être suis es est sommes êtes sont été étais était étions étiez étaient serai sera serons serez seront
avoir ai as a avons avez ont eu avais avait avions aviez avaient aurai aura aurons aurez auront
aller vais vas va allons allez vont faire fais fait faisons faites font pouvoir peux peut pouvons pouvez peuvent
vouloir veux veut voulons voulez veulent devoir dois doit devons devez doivent dire dis dit disons dites disent
c j m n s t y
""".split()
    )
)
