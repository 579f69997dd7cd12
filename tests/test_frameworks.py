"""Framework analyzers on small sources of our own, alone and in slices."""

from __future__ import annotations

import pytest

from quarrylake.functions.extract import extract
from quarrylake.functions.frameworks import DEFAULTS, Registry, collapsed_jsx, local_type, minified_class
from quarrylake.operators import resolve
from quarrylake.plans import frameworks, render, slices

API = '''from fastapi import APIRouter, Depends
from .schemas import Parcel, Receipt
router = APIRouter()

def open_session():
    yield None

async def signed_in(token: str) -> bool:
    return True

@router.post("/parcels", response_model=list[Receipt], dependencies=[Depends(signed_in)])
async def send(parcel: Parcel, db=Depends(open_session)) -> Receipt:
    return keep(db, parcel)
'''
SCHEMAS = '''from pydantic import BaseModel

class Street(BaseModel):
    """A street.

    Long."""
    name: str

class Parcel(BaseModel):
    weight: float
    to: Street

    def heavy(self) -> bool:
        return self.weight > 10

class Receipt(BaseModel):
    parcel: Parcel
    again: "Receipt"
'''
VIEWS = '''from rest_framework import serializers, viewsets
from django.db import models

class Depot(models.Model):
    name = models.CharField(max_length=9)

class Van(models.Model):
    depot = models.ForeignKey("fleet.Depot", on_delete=models.CASCADE)
    twin = models.OneToOneField("self", null=True)

    class Meta:
        ordering = ["id"]

    def __str__(self):
        return "van"

class DepotSerializer(serializers.ModelSerializer):
    class Meta:
        model = Depot

class VanSerializer(serializers.ModelSerializer):
    depot = DepotSerializer()

    class Meta:
        model = Van

class Mine(BasePermission):
    def has_permission(self, request, view):
        return True

class VanView(viewsets.ModelViewSet):
    queryset = Van.objects.all()
    serializer_class = VanSerializer
    permission_classes = [Mine]
    pagination_class = paging.Small

    @action(detail=True, permission_classes=[Driver])
    def drive(self, request):
        return 1
'''
CARD = '''import { useState } from 'react';
import { useDepot } from './useDepot';

interface CardProps {
  id: string;
}

export function Card({ id }: CardProps) {
  const [open, setOpen] = useState(false);
  const depot = useDepot(id);
  const other = useElsewhere();
  return (
    <div>
      <Title text={depot.name} />
      <section>
        <ul className={open ? 'a' : 'b'}>
          <li>one</li>
          <li>two</li>
        </ul>
        {open && <Row key={id} />}
        <svg viewBox="0 0 1 1" />
      </section>
    </div>
  );
}
'''
HOOK = "export function useDepot(id: string): Depot {\n  return load(id);\n}\n"
SERVER = '''import express from 'express';

interface OrderDto { total: number }
const limit = (n: number) => n;
export async function place(req: Request<{}, {}, OrderDto>, res: Response) {
  res.send(1);
}
const router = express.Router();
router.post('/orders', signIn, check(OrderSchema), place);
'''
NEST = '''import { Controller } from '@nestjs/common';

export class CreateCatDto { name: string }
export class CatDto { id: string }

@Controller('cats')
@UseGuards(KeyGuard)
export class Cats {
  @Post()
  @UseInterceptors(TimeInterceptor, LogInterceptor)
  async create(@Body() dto: CreateCatDto, @Param('id') id: string): Promise<CatDto> {
    return this.service.create(dto);
  }
}
'''
SPRING = '''import org.springframework.web.bind.annotation.*;

@RestController
@Secured("ROLE_A")
public class Orders {
    @PostMapping("/orders")
    @PreAuthorize("hasRole('B')")
    public ResponseEntity<OrderView> create(@Valid @RequestBody NewOrder order) {
        return null;
    }
}

record NewOrder(String id) {}
class OrderView { int id; }
'''


def roles(path, source, symbol, registry=None):
    out = {}
    for r in (registry or Registry()).refs(path, source):
        if r[3] == symbol:
            out.setdefault(r[5], []).append(r[6])
    return out


def test_fastapi():
    assert roles("api/routes.py", API, "send") == {"route": ["post"], "response": ["Receipt"], "parameter": ["Parcel"], "dependency": ["signed_in", "open_session"]}
    assert roles("api/schemas.py", SCHEMAS, "Parcel")["link"] == ["Street"]


def test_django():
    assert roles("fleet/views.py", VIEWS, "VanView") == {"model": ["Van"], "serializer": ["VanSerializer"], "permission": ["Mine", "Driver"], "pagination": ["Small"]}
    assert roles("fleet/views.py", VIEWS, "VanSerializer")["link"] == ["DepotSerializer", "Van"]
    assert roles("fleet/views.py", VIEWS, "Van")["link"] == ["Depot"]
    assert roles("fleet/views.py", VIEWS, "drive")["serializer"] == ["VanSerializer"]


def test_react():
    assert roles("ui/Card.tsx", CARD, "Card") == {"props": ["CardProps"], "hook": ["useDepot", "useElsewhere"]}
    more = "const B: React.FC<BProps> = ({ a }) => { return null };\nexport const F = React.forwardRef<HTMLInputElement, FProps>((p, r) => null);\n"
    assert roles("ui/b.tsx", more, "B")["props"] == ["BProps"] and roles("ui/b.tsx", more, "F")["props"] == ["FProps"]


def test_markup_folds_what_is_plain_and_deep():
    body = collapsed_jsx(CARD)
    assert "<Title text={depot.name} />" in body and "<Row key={id} />" in body and "<li>" not in body
    assert "<ul className={open ? 'a' : 'b'}>{/* 4 lines of markup */}</ul>" in body and '<svg />' in body
    assert collapsed_jsx("return 1;") == "return 1;" and collapsed_jsx("return (<div") == "return (<div"


def test_express():
    assert roles("web/server.ts", SERVER, "place") == {"route": ["post"], "middleware": ["signIn", "check(OrderSchema)"], "dto": ["OrderDto", "OrderSchema"]}


def test_nest():
    assert roles("web/cats.ts", NEST, "create") == {"guard": ["KeyGuard", "TimeInterceptor", "LogInterceptor"], "dto": ["CreateCatDto", "CatDto"]}


def test_spring():
    assert roles("src/Orders.java", SPRING, "create") == {"security": ['@Secured("ROLE_A")', "@PreAuthorize(\"hasRole('B')\")"], "dto": ["NewOrder", "OrderView"]}
    assert local_type(SPRING, "OrderView") == "class OrderView { int id; }" and local_type(SPRING, "NewOrder").startswith("record NewOrder") and local_type(SPRING, "None") is None


def test_minified_class():
    text = minified_class(VIEWS[VIEWS.index("class Van(") : VIEWS.index("class DepotSerializer")])
    assert text.startswith("class Van(models.Model):\n    depot = models.ForeignKey") and "class Meta:" in text and "def __str__(self): ..." in text and "return" not in text
    assert '"""A street."""' in minified_class(SCHEMAS[SCHEMAS.index("class Street") : SCHEMAS.index("class Parcel")]) and minified_class("not python (") == "not python ("


def test_registry():
    r = Registry()
    assert [a.name for a in r.analyzers] == ["fastapi", "django", "react", "express", "nest", "spring"]
    assert [a.name for a in r.matching("web/cats.ts", NEST)] == ["nest"] and [a.name for a in r.matching("a.py", "x = 1")] == []
    assert [a.name for a in r.matching("a.py", API + VIEWS)] == ["fastapi", "django"] and [a.name for a in r.matching("App.kt", "@RestController")] == ["spring"]
    none = Registry.empty()
    assert none.refs("a.py", API) == []
    none.register(DEFAULTS[0])
    assert {x[0] for x in none.refs("a.py", API)} == {"fastapi"}
    for a in DEFAULTS:
        for text in ("", "{{{", "def f(:", "return <", "@UseGuards(", "class X {", "app.get("):
            for path in ("x.py", "x.tsx", "x.ts", "X.java"):
                list(a.refs(path, text))


TREE = {
    ("api/routes.py", "python"): API, ("api/schemas.py", "python"): SCHEMAS, ("fleet/views.py", "python"): VIEWS, ("ui/Card.tsx", "typescript"): CARD, ("ui/useDepot.ts", "typescript"): HOOK,
    ("web/server.ts", "typescript"): SERVER, ("web/cats.ts", "typescript"): NEST,
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame([(p, lang, len(t), t) for (p, lang), t in TREE.items()], "path string, language string, size long, content string").cache()
    facts = extract(files).cache()
    links = resolve.follow_reexports(resolve.resolve_imports(facts, files), facts.where("fact = 'symbol'"))
    return files, facts, links, frameworks.framework_refs(files).cache()


def test_slices_have_what_their_frameworks_tie_to_them(spark, tree):
    files, facts, links, refs = tree
    q = spark.createDataFrame([(1, "api/routes.py", "send"), (2, "fleet/views.py", "VanView"), (3, "ui/Card.tsx", "Card"), (4, "web/server.ts", "place"), (5, "web/cats.ts", "Cats.create")], "query long, path string, symbol string")
    cut = slices.slices(facts, files, q, depth=0, include_types=False, include_calls=False)
    got = {r["query"]: r for r in render.measured(frameworks.enhance(cut, facts, files, links, refs), render.slice_markdown).collect()}
    types = {k: {t["name"]: t["body"] for t in r["types"]} for k, r in got.items()}
    calls = {k: {c["name"]: c["signature"] for c in r["calls"]} for k, r in got.items()}
    assert set(types[1]) == {"Receipt", "Parcel", "Street"} and "def heavy(self) -> bool: ..." in types[1]["Parcel"]
    assert calls[1]["open_session"] == "def open_session():" and calls[1]["signed_in"].startswith("async def signed_in")
    assert set(types[2]) == {"Van", "VanSerializer", "DepotSerializer", "Depot", "Mine"} and "def __str__(self): ..." in types[2]["Van"]
    assert "CardProps" in types[3] and calls[3]["useDepot"].startswith("export function useDepot") and calls[3]["useElsewhere"].startswith("function useElsewhere(")
    assert "lines of markup" in got[3]["body"] and "lines of markup" in got[3]["markdown"]
    assert "OrderDto" in types[4] and calls[4] == {"signIn": "// middleware: signIn", "check(OrderSchema)": "// middleware: check(OrderSchema)"}
    assert {"CreateCatDto", "CatDto"} <= set(types[5]) and calls[5]["KeyGuard"] == "// guard: KeyGuard"


def test_nothing_is_added_twice(spark, tree):
    files, facts, links, refs = tree
    q = spark.createDataFrame([(1, "api/routes.py", "send")], "query long, path string, symbol string")
    r = frameworks.enhance(slices.slices(facts, files, q), facts, files, links, refs).first()
    names = [t["name"] for t in r["types"]]
    assert len(names) == len(set(names)) and {"Parcel", "Receipt", "Street"} <= set(names)
