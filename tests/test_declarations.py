"""Declarations, calls and types of variables against hand-written expectations, language by language; each source mixes constructs that patterns get wrong."""

import pytest

from corvane.operators import languages as L

# language: source, all components, calls that must be there (scope>callee), words that no call may hold, bindings (scope.name:type)
CASES = {
    "typescript": (
        """
import { a } from "a";
/** A box. */
@Component({ selector: "x" })
export class Box<T extends Foo<Bar>> extends Base<T> implements Shape, Other<Map<string, T>> {
  private repo: Repo;
  static count = 0;
  #secret = (k: number): Id => { hidden(k); };
  constructor(private readonly svc: Service, other?: Maker) { super(); this.repo = new Repo(); }
  get size(): number { return this.measure(); }
  async *walk(x: Node): Result { yield* visit(`a ${inner(x)} b {no(} ${`deep ${deeper()}`}`); }
  load = async (id: string): Promise<Item> => { return this.repo.find(id).first(); };
  re() { return /gone(\\/[(]x{/.test(word) ? "gone(" : 'gone('; }
  generic<K extends keyof T>(k: K): void { make<K>(k); }
}
namespace Deep.Names {
  export function inside(a: A1): void { used(a); }
  export interface Face extends One, Two<Three> { area(): number; }
}
export abstract class Shape2 { abstract area(): number; draw(): void { this.area(); } }
declare module "m" { function ambient(): void; }
export type Alias<T> = { [k: string]: T } | null;
const enum Mode { A, B = compute() }
export const run = async (x: Thing): Promise<void> => {
  const y: Local = build();
  y.go();
}
export default function start() { return run(new Thing()); }
const plain = 3, list = [1, 2];
let later: (a: number) => string = (a) => text(a);
const old = function named() { return older(); };
// gone()
/* gone() */
""",
        "Box Box.#secret Box.constructor Box.size Box.walk Box.load Box.re Box.generic inside Face Shape2 Shape2.draw ambient Alias Mode run start later old",
        "Box>Base Box>Shape Box>Other Box.#secret>hidden Box.constructor>Repo Box.size>Box.measure Box.walk>visit Box.walk>inner Box.walk>deeper Box.load>Box.repo.find Box.generic>make inside>used Face>One Face>Two Shape2.draw>Shape2.area run>build run>y.go start>run start>Thing later>text old>older",
        "gone no Foo>",
        "Box.repo:Repo Box.constructor.svc:Service Box.constructor.other:Maker Box.walk.x:Node Box.walk.():Result Box.load.():Item inside.a:A1 run.y:Local run.x:Thing",
    ),
    "javascript": (
        """
'use strict'
import x from 'y'
/** Adds. */
export function add(a, b) { return `${total(a)} and ${ {k: `${deep(b)}`}.k }` }
function* gen() { yield one() }
export async function later() { await (await fetchIt()).json() }
class Cart extends mixin(Base) {
  static #n = 0
  total() { return this.sum(new Item(1)) }
  pick = k => helper(k)
  other = function (a) { return a.b?.c(1) }
  'quoted'() { no2() }
  [computed]() { no3() }
  static async make({ a, b }, [c]) { return new Cart(a) }
  set value(v) { this.#v = check(v) }
}
const run = async () => {
  add(1)
}
const obj = { method() { inObject() }, arrow: () => inArrow() }
var f = function () { return /}{("'/.exec(s) }
let g = (a, b) => a / b / half(a)
if (cond) { function nested() { deepCall() } }
module.exports = { add }
// gone()
""",
        "add gen later Cart Cart.total Cart.pick Cart.other Cart.make Cart.value run f g",
        "add>total add>deep gen>one later>fetchIt Cart.total>Cart.sum Cart.total>Item Cart.pick>helper Cart.other>a.b.c Cart.make>Cart Cart.value>check run>add g>half",
        "gone if",
        "",
    ),
    "java": (
        '''
package shop;
import java.util.*;
/** A cart. */
@Entity(name = "x")
public final class Cart<T extends Comparable<T>> extends Base<T> implements Sum, Iterable<Map<String, T>> {
  private final Repo repo = new Repo();
  @Inject Map<String, List<Item>> items;
  static { init(); }
  public Cart(Item i) throws IOException { this.first = i; check(i); }
  public <K> List<K> total(int k, Item... rest) { return repo.load().map(x -> Tax.of(x)); }
  String text() { return """
    class Gone { void gone() { no(); } }
    "quoted" \\""" still
    """; }
  class Inner { void one() { two(); } }
  enum Mode { A("x") { int f() { return 1; } }, B; Mode() {} int g() { return h(); } }
  record Point(int x, Item y) { Point { require(x); } int sum() { return x; } }
  interface Near { int near(int k); default int far() { return near(1); } }
  @interface Mark { String value() default "x"; }
  abstract int open(Thing t);
  char c = '"'; int after() { Runnable r = new Runnable() { public void run() { inside(); } }; return c; }
  Outer.Nested field;
}
sealed interface Sum permits Cart { }
''',
        "Cart Cart.Cart Cart.total Cart.text Cart.Inner Cart.Inner.one Cart.Mode Cart.Mode.Mode Cart.Mode.g Cart.Point Cart.Point.sum Cart.Near Cart.Near.near Cart.Near.far Cart.Mark Cart.Mark.value Cart.open Cart.after Sum",
        "Cart>Base Cart>Sum Cart>Iterable Cart>Repo Cart>List Cart>Item Cart.Cart>check Cart.total>repo.load Cart.total>Tax.of Cart.Inner.one>two Cart.Mode.g>h Cart.Near.far>near Cart.after>Runnable Cart.after>inside",
        "gone Gone no Comparable>",
        "Cart.repo:Repo Cart.Cart.i:Item Cart.open.t:Thing Cart.total.rest:Item Cart.after.r:Runnable Cart.field:Outer.Nested Cart.items:Map",
    ),
    "csharp": (
        '''
using System;
#if DEBUG
#endif
namespace A.B {
  /// <summary>Cart</summary>
  [Serializable, Table("x")]
  public sealed class Cart<T> : Base<T>, ISum where T : class, new() {
    private readonly Repo repo = new();
    public Item Item { get; private set; } = new Item();
    public int Count => Compute(1);
    string path = @"C:\\gone(\\""still"" {";
    public Cart(Item i) : base(i) { Check(i); }
    public async Task<Item> Total(int k, Tax tax) { return await tax.Of($"{Format(k)} {{gone()}} {k:N2}"); }
    public T Make<K>() where K : new() => Build<K>();
    public static Cart<T> operator +(Cart<T> a, Cart<T> b) => Join(a, b);
    var raw = """
      class Gone { void Gone() { } }
      """;
    protected internal virtual void Open() { }
    public event EventHandler Changed;
    public int this[int i] { get { return At(i); } }
    struct Point { public int X; public int Sum() { return X; } }
    ~Cart() { Free(); }
  }
  public record Money(decimal Amount, Currency Unit);
  public record struct Pair(int A);
  public enum Mode { A = 1, B }
  public interface ISum : IOne, ITwo { int Total(int k); }
  public delegate int Handler(object o);
}
''',
        "Cart Cart.Item Cart.Count Cart.Cart Cart.Total Cart.Make Cart.operator+ Cart.Open Cart.Point Cart.Point.Sum Cart.~Cart Money Pair Mode ISum ISum.Total Handler",
        "Cart>Base Cart>ISum Cart.Cart>Check Cart.Total>tax.Of Cart.Total>Format Cart.Make>Build Cart.operator+>Join Cart.Count>Compute Cart.~Cart>Free ISum>IOne ISum>ITwo",
        "gone Gone new ",
        "Cart.repo:Repo Cart.Item:Item Cart.Total.tax:Tax Cart.Total.():Item Cart.Cart.i:Item",
    ),
    "c": (
        """
#include <x.h>
#define LOOP(x) do { gone(x); \\
  gone2(x); } while (0)
typedef struct { int x; struct node *next; } point;
typedef struct node { int y; } node_t;
struct plain { int z; };
union both { int a; float b; };
static inline int *find(struct node *n, int k) { return look(n, k); }
int old(a, b)
  int a;
  char *b;
{
  return older(a);
}
char *names[] = { "gone(", "x" };
int proto(int k);
API_EXPORT void exported(void) { struct node *m = make(); (*callback)(1); m->call(2); }
__attribute__((unused)) static void attr(void) { if (x) { y(); } }
struct node *maker(void) { return 0; }
const char *text = "a \\" b"; int after(void) { return '"'; }
int main(int argc, char **argv) { /* gone() */ return find(0, sizeof(int)) ? 1 : 0; } // gone()
""",
        "point node plain both find old exported attr maker after main",
        "find>look old>older attr>y main>find exported>make exported>m.call",
        "gone proto sizeof if",
        "find.n:node exported.m:node maker.():node",
    ),
    "cpp": (
        """
#include <vector>
namespace a { namespace b {
template <typename T, class U = std::vector<T>>
class API_EXPORT Cart final : public Base<T>, private virtual ns::Other {
 public:
  explicit Cart(Item i) : item(i), list{1, 2} { init(); }
  ~Cart() override { drop(); }
  int total() const noexcept override { return sum(items); }
  Item* find(const Key& key);
  Cart& operator=(const Cart& o) = default;
  bool operator==(const Cart& o) const { return same(o); }
  static std::unique_ptr<Cart> make();
  struct Inner { int deep() { return deeper(); } };
  enum class Mode { A, B };
 private:
  Item item; std::vector<Tax> taxes = build();
};
}}
int a::b::Cart::price(int k) const { return tax(k) + R"x(gone( " )y" )x".size(); }
Cart::Cart(Item i, int k) : item(i) { setup(k); }
template <> void special<int>(int x) { auto p = std::make_unique<Cart>(x); p->run(); }
using Id = std::map<int, Cart>;
extern "C" { int plain(void) { return 1'000'000 + inC(); } }
typedef struct { int q; } quick;
Item* global(Item* x) { for (auto& y : x->all()) { y.go(); } return new Item(); }
auto lambda = [](int x) { return inLambda(x); };
enum Color { Red };
""",
        "Cart Cart.Cart Cart.~Cart Cart.total Cart.operator== Cart.Inner Cart.Inner.deep Cart.Mode a.b.Cart.price special Id plain quick global Color",
        "Cart>Base Cart>ns::Other Cart.Cart>init Cart.~Cart>drop Cart.total>sum Cart.operator==>same Cart.Inner.deep>deeper a.b.Cart.price>tax special>std::make_unique special>p.run plain>inC global>x.all global>Item",
        "gone build find",
        "Cart.item:Item global.x:Item global.():Item Cart.Cart.i:Item",
    ),
    "kotlin": (
        '''
@file:JvmName("x")
package a.b
/* outer /* fun gone() {} */ fun gone2() {} */
data class Item(val price: Money, private val n: Int = one()) : Base(price), Sum, Other by del(1) { fun short() = tiny(); val later by lazy { heavy() } }
sealed interface Shape { fun area(): Double }
enum class Mode(val k: Int) { A(1) { override fun f() = 2 }, B(3); fun g() = h() }
object Single : Base() { fun only(): Item { return Item("${inner(1)} $x {gone(}") } }
class Cart<T : Comparable<T>>(repo: Repo) : Base<T>() where T : Any {
  private val repo: Repo = repo
  lateinit var tax: Tax
  init { setup() }
  constructor(k: Int) : this(Repo()) { second(k) }
  fun total(k: Int): Int =
    add(k) +
      more(k)
  suspend inline fun <reified R> fetch(
    id: Id,
  ): R? { return repo.load(id)?.let { it.go() } }
  companion object { fun make() = Cart<Int>(1) }
  companion object Named { const val X = """ fun gone() { } ${raw()} " """ }
  inner class Deep { fun down() { up() } }
}
fun String.shout(): String = upper(this)
fun List<Item>.sum(f: (Int) -> Int): Int { return f(1) }
fun interface Call { fun call() }
typealias Id = String
''',
        "Item Item.short Shape Shape.area Mode Mode.g Single Single.only Cart Cart.constructor Cart.total Cart.fetch Cart.Companion Cart.Companion.make Cart.Named Cart.Deep Cart.Deep.down shout sum Call Call.call",
        "Item>Base Item>Sum Item>Other Item.short>tiny Mode.g>h Single>Base Single.only>Item Single.only>inner Cart>Base Cart.constructor>second Cart.total>add Cart.total>more Cart.fetch>repo.load Cart.Companion.make>Cart Cart.Deep.down>up shout>upper",
        "gone Comparable>",
        "Item.price:Money Cart.repo:Repo Cart.tax:Tax Single.only.():Item Cart.fetch.id:Id",
    ),
    "php": (
        """<html> function gone() {
<?php
namespace A\\B;
use X\\Y as Z;
#[Attr(1)]
abstract class Cart extends \\X\\Base implements Sum, Other {
  use T, U\\V;
  private ?Repo $repo;
  public function __construct(private readonly Item $item, ?Tax $tax = null) { $this->repo = new Repo(); parent::__construct(); }
  public static function make(): static { return new self(Rate::of(1)); }
  abstract protected function open(int $k): ?Item;
  public function text() { return <<<EOT
  function gone() { {$this->inner()} }
  EOT . tail(); }
  function raw() { $x = <<<'NOW'
function gone() {
NOW;
    return after("a {$this->deep(1)} b", 'gone()'); } // gone()
  public function next() { $f = fn($x) => short($x); return $this->repo->load()->first(); }
}
interface Sum { const A = 1; public function total(Item $i); }
trait T { function shared() { help(); } }
enum Mode: string { case A = 'a'; public static function from2() { return self::A; } }
function &plain(array $a) { # gone()
  return call($a); }
$anon = new class extends Base { function inAnon() { x1(); } };
""",
        "Cart Cart.__construct Cart.make Cart.open Cart.text Cart.raw Cart.next Sum Sum.total T T.shared Mode Mode.from2 plain",
        "Cart>X\\Base Cart>Sum Cart>Other Cart>T Cart>U\\V Cart.__construct>Repo Cart.make>Rate Cart.text>Cart.inner Cart.text>tail Cart.raw>after Cart.raw>Cart.deep Cart.next>short Cart.next>Cart.repo.load T.shared>help plain>call",
        "gone",
        "Cart.repo:Repo Cart.__construct.item:Item Cart.__construct.tax:Tax Cart.open.():Item Sum.total.i:Item",
    ),
    "ruby": (
        """
require 'x'
=begin
def gone; end
=end
module Shop
  class Cart < Shop::Base
    include Sum, Other
    extend Helper
    attr_reader :a
    def initialize(k) = @repo = Repo.new(k)
    def total(k)
      return 0 if k.nil?
      x = if k > 1 then add(k) else sub(k) end
      while k > 0 do step(k) end
      items.each do |i|
        pay(i) unless i.free?
      end
      text = <<~EOS
        def gone
          #{no}
      EOS
      "a #{inner(k)} end" + %w[end def].join(' ') + /end(/.source
      begin
        risky(k)
      rescue E => e
        handle(e)
      ensure
        close(1)
      end
    end
    def self.make(a) Tax.new(1) end
    def ==(other) = same(other)
    def [](k) ; at(k) ; end
    def name=(v); @name = check(v); end
    def ok?; yes(1); end
    class << self
      def single; lone(1); end
    end
    private def hidden(x) ; y(x) ; end
    Error = Class.new(StandardError)
    until done?(1) do wait(1) end
  end
  def self.top; bottom(1); end
end
class Shop::Late; def one; two(2); end; end
# def gone; end
""",
        "Shop Shop.Cart Shop.Cart.initialize Shop.Cart.total Shop.Cart.make Shop.Cart.== Shop.Cart.[] Shop.Cart.name= Shop.Cart.ok? Shop.Cart.single Shop.Cart.hidden Shop.top Shop.Late Shop.Late.one",
        "Shop.Cart>Shop::Base Shop.Cart>Sum Shop.Cart>Other Shop.Cart>Helper Shop.Cart.initialize>Repo Shop.Cart.total>add Shop.Cart.total>sub Shop.Cart.total>step Shop.Cart.total>pay Shop.Cart.total>inner Shop.Cart.total>risky Shop.Cart.total>handle Shop.Cart.total>close Shop.Cart.make>Tax Shop.Cart.==>same Shop.Cart.[]>at Shop.Cart.name=>check Shop.Cart.ok?>yes Shop.Cart.single>lone Shop.Cart.hidden>y Shop.top>bottom Shop.Late.one>two",
        "gone",
        "Shop.Cart.repo:Repo",
    ),
    "scala": (
        '''
package a.b
/* a /* def gone() = 1 */ def gone2() = 2 */
sealed trait Shape[T] extends Base[T] with Other { def area: Double; def twice(k: Int): Int = dbl(k) }
case class Cart(item: Item, private val n: Int = one())(implicit e: Env) extends Base(item) with Sum {
  val repo: Repo = new Repo
  def total(k: Int)(j: Int): Int =
    add(k) +
      more(j)
  def text = s"a ${inner(1)} $x { ${Seq(1).map(f(_))}" + """ def gone() = { " """
  private[b] def hidden[A <: Item](a: A): Unit = { repo.load(a); a match { case Item(x) => use(x) } }
  class Deep { def down(): Unit = up() }
}
object Cart { def make(): Cart = new Cart(null); val c = '"' ; def after() = then2() }
enum Color { case Red, Green; def hex(): Int = code(1) }
abstract class Open(tax: Tax) { def go(t: Tax): Item }
def top(x: Int) = bottom(x)
''',
        "Shape Shape.area Shape.twice Cart Cart.total Cart.text Cart.hidden Cart.Deep Cart.Deep.down Cart$ Cart.make Cart.after Color Color.hex Open Open.go top",
        "Shape>Base Shape>Other Cart>Base Cart>Sum Shape.twice>dbl Cart.total>add Cart.total>more Cart.text>inner Cart.hidden>repo.load Cart.hidden>use Cart.Deep.down>up Cart.make>Cart Cart.after>then2 Color.hex>code top>bottom",
        "gone",
        "Cart.repo:Repo Cart.item:Item Open.tax:Tax Open.go.t:Tax Open.go.():Item Cart.make.():Cart",
    ),
    "rust": (
        """
use a::b::{c, d};
/* a /* fn gone() {} */ fn gone2() {} */
#[derive(Debug, Clone)]
pub(crate) struct Cart<'a, T: Sum> where T: Debug { item: Item, list: Vec<Tax>, r: &'a str }
pub struct Unit; pub struct Pair(Left, pub Right);
union Both { a: u32 }
pub enum Mode { A, B(Item), C { x: Tax } }
pub trait Sum: Base + Send { fn total(&self) -> i32; fn twice(&self) -> i32 { self.total() * 2 } }
impl<'a, T> Sum for Cart<'a, T> where T: Debug + Fn(i32) -> i32 { fn total(&self) -> i32 { self.add(1); helper::<i32>(2); format!("gone({})", inner!(3)) as i32 } }
impl Cart<'_, u8> { pub fn new(k: Key) -> Self { Self { item: Item { n: 1 }, list: vec![tax(1)] } } pub(super) async unsafe fn go(&mut self, t: &mut Tax) -> Option<Item> { let x: Box<Local> = make(); Cart::new(k).run(); None } }
impl fmt::Display for Mode { fn fmt(&self) -> R { match self { Mode::A => write(1), _ => 'a'.len() } } }
#[cfg(test)]
mod tests { use super::*; #[test] fn gone() { gone3(); } }
#[cfg(not(test))]
mod real { pub fn kept() { used(); } }
pub const fn konst(x: i32) -> i32 { let c = '"'; let s = r#"fn gone() { " }"#; let l = 'x'; bottom(x) }
macro_rules! mac { ($x:expr) => { $x }; }
extern "C" { fn imported(x: i32); }
""",
        "Cart Unit Pair Both Mode Sum Sum.total Sum.twice Cart.total Cart.new Cart.go Mode.fmt kept konst imported",
        "Sum>Base Sum>Send Cart>Sum Mode>Display Sum.twice>Sum.total Cart>Tax Cart.go>Item Cart.total>Cart.add Cart.total>helper Cart.total>format Cart.new>Item Cart.new>tax Cart.go>make Cart.go>Cart::new Mode.fmt>write kept>used konst>bottom",
        "gone pub Debug",
        "Cart.item:Item Cart.list:Vec Cart.new.k:Key Cart.new.():Cart Cart.go.t:Tax Cart.go.x:Local Cart.go.():Option",
    ),
    "dart": (
        """
import 'a.dart';
/* a /* void gone() {} */ */
abstract class Page<T extends Item> extends StatelessWidget with M, N<T> implements O {
  final Item item;
  late Map<String, Tax> taxes = load();
  const Page(this.item, {Key? key, required this.x}) : super(key: key);
  Page.named(Item i) : item = i, x = calc(i) { init(); }
  factory Page.of(Context c) => Page(c.find());
  int get size => measure(1);
  set size(int v) { store(v); }
  static Future<Item> fetch(String id) async { return await repo.load('$id ${inner(id)} {gone(}'); }
  Widget build(BuildContext c) { return Text(item.name(), style: s ?? other()); }
  void abstractOne();
  bool operator ==(Object o) => same(o);
  List<T> all<K>(K k) => [for (var i in k.items()) wrap(i)];
  String raw() => r'gone(' + '''gone("''' + tail();
}
mixin M on Base { void mixed() { help(); } }
extension Ext on String { int count() => len(this); }
enum Mode { a, b; int idx() => pos(1); }
typedef F = void Function(int);
void main() { runApp(Page(1)); }
Item top(Tax t) => t.item();
""",
        "Page Page.Page Page.Page.named Page.Page.of Page.size Page.fetch Page.build Page.operator== Page.all Page.raw M M.mixed Ext Ext.count Mode Mode.idx main top",
        "Page>StatelessWidget Page>M Page>N Page>O Page.size>measure Page.fetch>repo.load Page.fetch>inner Page.build>Text Page.build>item.name Page.build>other Page.operator==>same Page.all>wrap Page.raw>tail M.mixed>help Ext.count>len Mode.idx>pos main>runApp top>t.item",
        "gone",
        "Page.item:Item Page.fetch.():Item Page.build.c:BuildContext top.t:Tax top.():Item",
    ),
    "go": (
        """
package a

import (
	"fmt"
)

type (
	Cart struct {
		Base
		*pkg.Other
		item  *Item
		x, y  int
		List  []Tax `json:"gone()"`
		fn    func(k Key) error
		Inner struct{ Deep Thing }
	}
	Sum interface {
		Total(k int) int
		Near
	}
	ID = int
)
type Box[T any] struct{ v T }
type Handler func(w Writer, r *Request)

func (c *Cart) Total(k int, t *Tax) (int, error) {
	s := `func gone() { "`
	for i := range c.items() { go c.add(i) }
	if x := look(k); x != nil { return t.Of(x).Next() }
	defer func() { done() }()
	return c.item.Price(k), fmt.Errorf("gone(%d)", 1)
}
func (Cart) plain() interface{} { return other.Of(1) }
func (b *Box[T]) Get() T { return b.v }
func New(r Repo) *Cart { var t Tax; u := &Tax{Rate: rate()}; t.go1(); return &Cart{item: u.item()} }
func Map[K comparable, V any](m map[K]V, f func(K) V) []V { return nil }
func two() struct{ a int } { return call2() }
var _ Sum = (*Cart)(nil)
var handlers = map[string]Handler{"x": top(1)}
// func gone() {}
""",
        "Cart Sum ID Box Handler Cart.Total Cart.plain Box.Get New Map two",
        "Cart>Base Cart>pkg.Other Cart.Total>Cart.items Cart.Total>Cart.add Cart.Total>look Cart.Total>t.Of Cart.Total>done Cart.Total>Cart.item.Price Cart.plain>other.Of New>Tax New>rate New>Cart New>u.item two>call2",
        "gone Total( func",
        "Cart.item:Item Cart.List:Tax Cart.Total.t:Tax New.r:Repo New.():Cart New.t:Tax New.u:Tax",
    ),
    "zig": (
        """
const std = @import("std");
pub const Cart = struct {
    item: Item,
    const Self = @This();
    pub fn total(self: *Cart, k: i32) i32 { return add(k) + self.item.price(); }
    const Inner = struct { fn deep() void { deeper(); } };
};
pub fn List(comptime T: type) type {
    return struct {
        items: []T,
        pub fn append(self: *@This(), x: T) !void { grow(x); }
    };
}
const Mode = enum { a, b, fn idx(m: Mode) u8 { return pos(m); } };
const Both = union(enum) { a: u32, b: Item };
const text =
    \\\\ fn gone() { "
    \\\\ gone(
;
fn after(x: u8) Item { const y = Cart{ .item = make() }; return y.total(1) orelse other(); }
export fn c_abi() void { if (x) |v| { use(v); } }
test "gone()" { try inTest(); }
// fn gone() {}
""",
        "Cart Cart.total Cart.Inner Cart.Inner.deep List List.append Mode Mode.idx Both after c_abi",
        "Cart.total>add Cart.Inner.deep>deeper List.append>grow Mode.idx>pos after>Cart after>make after>y.total after>other c_abi>use",
        "gone",
        "Cart.item:Item Cart.total.self:Cart after.():Item after.y:Cart",
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_constructs(language):
    text, components, calls, never, bindings = CASES[language]
    rows = L.read_file("src/a.x", text, language)
    short = lambda i: i.split("::", 1)[1]
    assert sorted(short(r["id"]) for r in rows if r["row_kind"] == "component") == sorted(components.split())
    got = {f"{short(r['id'])}>{r['callee']}" for r in rows if r["row_kind"] == "call"}
    assert set(calls.split()) - got == set()
    bad = never.split() if not never.endswith(" ") else [*never.split()]
    assert not [x for x in got for b in bad if x.split(">", 1)[1].split(".")[0].split("::")[0] == b.rstrip(">(") and b]
    types = {f"{short(r['id'])}.{r['name']}:{r['callee']}" for r in rows if r["row_kind"] == "binding"}
    assert set(bindings.split()) - types == set()
    for r in rows:
        if r["row_kind"] == "component":
            assert r["end_line"] >= r["start_line"] and text.split("\n")[r["start_line"] - 1].strip()


@pytest.mark.parametrize("language", CASES)
def test_any_cut_of_a_file_is_read(language):
    """A file that breaks off, or starts in the middle, loses neither itself nor the reader."""
    text = CASES[language][0]
    for at in range(0, len(text), 37):
        for part in (text[:at], text[at:], text[:at] + "}" + text[at:]):
            assert any(r["row_kind"] == "component" for r in L.read_file("a.x", part, language))


def test_long_and_deep_files_are_read_in_time():
    for text, language in (("f(" * 3000, "java"), ("{" * 5000, "typescript"), ("a<" * 3000, "csharp"), ("x = `${" * 2000, "javascript"), ("if x\n" * 400, "ruby"), ("class A {\n" * 150, "kotlin"), ("def f(x) = g(x)\n" * 3000, "scala")):
        assert L.read_file("a.x", text, language)
