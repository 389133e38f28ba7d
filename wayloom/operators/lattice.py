"""Which types go together, and casts that lose nothing.

Numbers widen from byte over short, int and long to double, with float and decimals between, dates
widen to timestamps, and a column that only ever was NULL to anything. Structs widen field by field,
arrays and maps by what they hold. Text goes with nothing else: what would be a guess is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Digits that every value of the type fits into.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


def wider(one: T.DataType, other: T.DataType) -> T.DataType | None:
    """The least type that holds the values of both, None if the two do not go together.

    Decimals beyond 38 digits and whole numbers beside fractions meet in double, which holds whole
    numbers up to 2^53 exactly; :func:`exactly` refuses values that it does not hold.
    """
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    kinds = (type(one), type(other))
    if set(kinds) <= {*_INTEGRAL}:
        return max((one, other), key=lambda t: _INTEGRAL.index(type(t)))
    if set(kinds) <= {*_INTEGRAL, T.DecimalType}:
        return _decimal(*map(_as_decimal, (one, other)))
    if all(isinstance(t, T.NumericType) for t in (one, other)):
        small = (T.ByteType, T.ShortType, T.FloatType)
        return T.FloatType() if set(kinds) <= {*small} else T.DoubleType()
    if set(kinds) == {T.DateType, T.TimestampType} or set(kinds) == {T.DateType, T.TimestampNTZType}:
        return max((one, other), key=lambda t: _TIMES.index(type(t)))
    if kinds == (T.ArrayType, T.ArrayType):
        element = wider(one.elementType, other.elementType)
        return element and T.ArrayType(element, one.containsNull or other.containsNull)
    if kinds == (T.MapType, T.MapType):
        key, value = wider(one.keyType, other.keyType), wider(one.valueType, other.valueType)
        return key and value and T.MapType(key, value, one.valueContainsNull or other.valueContainsNull)
    if kinds == (T.StructType, T.StructType):
        return _wider_struct(one, other)
    return None


def _wider_struct(one: T.StructType, other: T.StructType) -> T.StructType | None:
    more = {f.name.lower(): f for f in other.fields}
    fields = []
    for field in one.fields:
        beside = more.pop(field.name.lower(), None)
        found = wider(field.dataType, beside.dataType) if beside else field.dataType
        if found is None:
            return None
        fields.append(T.StructField(field.name, found, True))
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in more.values()])


def _as_decimal(kind: T.DataType) -> T.DecimalType:
    return kind if isinstance(kind, T.DecimalType) else T.DecimalType(_DIGITS[type(kind)], 0)


def _decimal(one: T.DecimalType, other: T.DecimalType) -> T.DataType:
    scale = max(one.scale, other.scale)
    precision = max(one.precision - one.scale, other.precision - other.scale) + scale
    return T.DecimalType(precision, scale) if precision <= 38 else T.DoubleType()


def exactly(value: Column, found: T.DataType, wanted: T.DataType, name: str) -> Column:
    """The value in the wanted type; the job fails, naming the column, where that would change it.

    Widening is a plain cast. Anything can become text. For all else a value is cast there and back
    and must be what it was. Types that cannot be cast are refused at once.
    """
    if found == wanted:
        return value
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(found, nested) or (isinstance(wanted, nested) and not isinstance(found, T.NullType)):
        if isinstance(wanted, T.StringType):
            return value.cast(wanted)
        if not same(wider(wanted, found), wanted):
            raise TypeError(f"column {name}: {found.simpleString()} into {wanted.simpleString()}")
        return _nested(value, found, wanted, name)
    cast = value.cast(wanted)
    if isinstance(found, T.NullType) or isinstance(wanted, T.StringType):
        return cast
    whole = isinstance(found, (T.LongType, T.DecimalType)) and isinstance(wanted, (T.FloatType, T.DoubleType))
    if wider(wanted, found) == wanted and not whole:
        return cast
    kinds = f"{found.simpleString()} to {wanted.simpleString()}"
    if isinstance(found, T.StringType):
        changed = value.try_cast(wanted).isNull()
    else:
        changed = ~value.try_cast(wanted).try_cast(found).eqNullSafe(value)
    message = F.concat(F.lit(f"column {name}: {kinds} would change "), value.cast("string"))
    return F.when(value.isNotNull() & changed, F.raise_error(message)).otherwise(value.try_cast(wanted))


def same(one: T.DataType | None, other: T.DataType) -> bool:
    """Equal but for what may be NULL."""
    return one is not None and one.simpleString() == other.simpleString()


def _nested(value: Column, found: T.DataType, wanted: T.DataType, name: str) -> Column:
    """A struct, array or map in the wanted type, which is at least as wide."""
    if isinstance(wanted, T.StructType):
        have = {f.name.lower(): f for f in found.fields}
        fields = []
        for field in wanted.fields:
            own = have.get(field.name.lower())
            part = F.lit(None).cast(field.dataType)
            if own:
                part = exactly(value.getField(own.name), own.dataType, field.dataType, f"{name}.{field.name}")
            fields.append(part.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: exactly(x, found.elementType, wanted.elementType, f"{name}[]"))
    keys = F.transform(F.map_keys(value), lambda x: exactly(x, found.keyType, wanted.keyType, name))
    values = F.transform(F.map_values(value), lambda x: exactly(x, found.valueType, wanted.valueType, f"{name}[]"))
    return F.map_from_arrays(keys, values)


def conform(table: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in order and type; columns that are absent are NULL.

    No value is changed on the way: see :func:`exactly`. Column names are compared as Spark does,
    without regard to case.
    """
    have = {f.name.lower(): f for f in table.schema.fields}
    columns = []
    for field in schema.fields:
        found = have.get(field.name.lower())
        if found is None:
            column = F.lit(None).cast(field.dataType)
        else:
            column = exactly(F.col(f"`{found.name}`"), found.dataType, field.dataType, field.name)
        columns.append(column.alias(field.name))
    return table.select(*columns)


def widened(have: T.StructType, arriving: T.StructType) -> T.StructType:
    """The schema that holds both: wider types where needed, new columns behind the others.

    Raises ``TypeError`` for columns whose types do not go together.
    """
    known = {f.name.lower(): f for f in have.fields}
    refused, types = [], {}
    for field in arriving.fields:
        beside = known.get(field.name.lower())
        if beside is None:
            continue
        types[beside.name] = wider(beside.dataType, field.dataType)
        if types[beside.name] is None:
            refused.append(f"column {beside.name}: {field.dataType.simpleString()} into {beside.dataType.simpleString()}")
    if refused:
        raise TypeError("; ".join(refused))
    fields = [T.StructField(f.name, types.get(f.name, f.dataType), f.nullable) for f in have.fields]
    new = [f for f in arriving.fields if f.name.lower() not in known]
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in new])
