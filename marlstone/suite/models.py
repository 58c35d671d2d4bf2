"""The driver's tables, and the user tables of the tests, as a model."""

WAREHOUSE = """
namespace warehouse

table Region { @@r_regionkey: i32, r_name: utf8 }
table Nation { @@n_nationkey: i32, n_name: utf8, n_regionkey: &Region }
table Supplier { @@s_suppkey: i64, s_name: utf8, s_nationkey: &Nation, s_acctbal: f64 }
table Customer { @@c_custkey: i64, c_name: utf8, c_nationkey: &Nation, c_acctbal: f64, c_mktsegment: utf8 }
table Part { @@p_partkey: i64, p_name: utf8, p_brand: utf8, p_type: utf8, p_size: i32, p_retailprice: f64 }
table Orders {
    @@o_orderkey: i64,
    o_custkey: &Customer,
    o_orderstatus: utf8,
    o_totalprice: f64,
    o_orderdate: datetime,
    o_orderpriority: utf8,
}
# Lines have no key of one field, so they are a read-only collection.
class Lineitem {
    l_orderkey: &Orders, l_partkey: &Part, l_suppkey: &Supplier, l_linenumber: i32,
    l_quantity: f64, l_extendedprice: f64, l_discount: f64, l_tax: f64,
    l_returnflag: utf8, l_linestatus: utf8, l_shipdate: datetime,
}
table Events { @@event_id: i64, ts: datetime, user_id: &Customer?, event_type: utf8, value: f64, props: utf8 }
table Embeddings { @@vec_id: i64, embedding: vector<64>, label: i32 }
table Documents { @@doc_id: i64, text: utf8, lang: utf8, source: utf8, n_chars: i64 }
table Labels { @@doc_id: i64, quality: i32, toxic: i32 }

enums Quality { Poor = 0, Good = 1 }
flags SizeBit { One = 1, Two = 2, Four = 4, Eight = 8 }
const floor_price: f64 = 1500.0;

macro spoken(value: utf8) -> utf8 { value.trim().lower() }
query customers_of(segment: utf8, least: f64) -> [Customer] {
    Customer.filter(c => c.c_mktsegment == segment && c.c_acctbal > least)
}
udf net(price: f64, discount: f64) -> f64 { price * (1 - discount) }
"""
