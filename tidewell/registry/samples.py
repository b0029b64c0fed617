"""Rows the registered queries hold in the program, next to the given tables."""

# (source_file, raw_content)
DOCUMENTS = [
    ("note-a.html", "<h1>Opening  hours</h1> The desk is open\tfrom nine to five."),
    ("note-b.txt", "Parcels   wait at the desk for\n\n14 days."),
    ("note-c.txt", None),
    ("note-d.txt", "   "),
]

# (id, topic, content): one line per speaker of a conversation
SPEAKERS = [
    (1, "user", "Asks the questions of a conversation."),
    (2, "assistant", "Answers the questions of a conversation."),
    (3, "system", "Sets the rules of a conversation."),
]

# (id, topic, content): knowledge entries that questions are matched with
ENTRIES = [
    (1, "Hours", "The desk is open in the morning and on the first day of the month."),
    (2, "Horario", "La oficina de la planta baja es la que abre de lunes a viernes."),
    (3, "Horaires", "Le bureau est ouvert le matin et la salle est libre les autres jours."),
    (4, "Zeiten", "Das Amt ist am Morgen offen und der Saal ist an den anderen Tagen frei."),
]


class Excerpts:
    """A generator without a model: the beginning of the context, and how long the prompt is.

    It refuses prompts of more than ``MOST_PROMPT`` characters.
    """

    MOST_PROMPT = 1700

    def generate(self, prompts: list[str], max_length: int) -> list[str]:
        if any(len(prompt) > self.MOST_PROMPT for prompt in prompts):
            raise ValueError("prompt too long")
        found = []
        for prompt in prompts:
            context = prompt.split("Context:\n", 1)[1]
            found.append(f"{len(prompt.split(' '))} words asked about {context}")
        return found
