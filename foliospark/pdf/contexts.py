"""What paints in a document, and the resources that it names colours from."""

from __future__ import annotations

from dataclasses import dataclass

from foliospark.pdf.model import Document, Ref, Stream

#: The entry of a content stream that makes it one which others paint, by kind.
PAINTED = {"form": ("/Subtype", "/Form"), "tiling": ("/PatternType", 1)}


@dataclass
class Context:
    """A page, or a form or tiling pattern. `holder`: the dictionary that has its resources or would have them."""

    owner: Ref
    kind: str
    holder: dict

    def resources(self, document: Document) -> dict:
        """Its own resources, or a page's inherited ones."""
        found = document.inherited(self.holder, "/Resources") if self.kind == "page" else document.get(self.holder.get("/Resources"))
        return found if isinstance(found, dict) else {}

    def spaces(self, document: Document) -> dict:
        """Its colour spaces by name."""
        found = document.get(self.resources(document).get("/ColorSpace"))
        return found if isinstance(found, dict) else {}

    def own_spaces(self, document: Document) -> dict | None:
        """The same as a dictionary to be changed, made where there is none; a page gets copies of what it inherits.

        None where it has no place: a form without resources uses those of what paints it.
        """
        resources = document.get(self.holder.get("/Resources"))
        if not isinstance(resources, dict):
            if self.kind != "page":
                return None
            resources = self.holder["/Resources"] = dict(self.resources(document))
            if "/ColorSpace" in resources:
                resources["/ColorSpace"] = dict(self.spaces(document))
        if document.get(resources.get("/ColorSpace")) is None:
            resources["/ColorSpace"] = {}
        found = document.get(resources["/ColorSpace"])
        return found if isinstance(found, dict) else None


def contexts(document: Document) -> list[Context]:
    """The pages in order, then the forms and tiling patterns that they paint, directly or through others, each once.

    Soft-mask groups of graphics states aren't among them: their colours become opacity.
    """
    found = [Context(ref, "page", document.get(ref)) for ref in document.pages()]
    known: set[Ref] = set()
    for c in found:  # grows while it is read
        resources = c.resources(document)
        named = [document.get(resources.get(k)) for k in ("/XObject", "/Pattern")]
        for ref in [v for group in named if isinstance(group, dict) for v in group.values() if isinstance(v, Ref)]:
            stream = document.get(ref)
            kinds = [k for k, (key, value) in PAINTED.items() if isinstance(stream, Stream) and document.get(stream.entries.get(key)) == value]
            if kinds and ref not in known:
                known.add(ref)
                found.append(Context(ref, kinds[0], stream.entries))
    return found
